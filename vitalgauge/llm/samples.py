"""Bounded training samples, and the split that keeps a fifth of the rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows of those that may be learned from: the first by a hash of their id."""
    return rows.where(~held_out(key)).orderBy(F.xxhash64(key), *rows.columns).limit(most)
