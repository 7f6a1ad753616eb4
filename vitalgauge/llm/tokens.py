"""Encoding and decoding whole documents, and the digests of both.

Defined cases: a null text is an empty text, which has no ids and decodes to an empty
text; a null id is kept; repeated rows are each encoded; an empty table gives an
empty table; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder


def pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of the whole text, without special tokens added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for i, j, ids, n in enc.blocks(b.column(1).to_pylist()):
                at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], ["doc_id", "ids"])

    return pairs(df, key, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text: the labels of the ids, one space between them; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = encoder(tokenizer).auto
        for b in batches:
            rows = [auto.decode(np.array(x or [], np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id's decimal digits and a space, in rows of equal width, and which bytes count."""
    text = [f"{i} ".encode() for i in range(size)]
    width = max(map(len, text))
    out = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in text), np.uint8).reshape(size, width)
    return out, out != 0


def round_trip(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with one space between them) and
    decoded_sha256 (of the text that the ids decode to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        digits, real = decimals(enc.auto.size)
        width = real.sum(1)
        sha = hashlib.sha256
        for b in batches:
            for i, j, ids, n in enc.blocks(b.column(1).to_pylist()):
                ends = np.cumsum(n)
                line = memoryview(digits[ids][real[ids]])
                upto = np.concatenate([[0], np.cumsum(width[ids])])[np.concatenate([[0], ends])].tolist()
                back, cuts = enc.auto.decode(ids), np.concatenate([[0], np.cumsum(enc.auto.text_len[ids] + 1)])[np.concatenate([[0], ends])].tolist()
                back = memoryview(back)
                digest = [sha(line[s : max(s, e - 1)]).hexdigest() for s, e in zip(upto, upto[1:], strict=False)]
                decoded = [sha(back[s : max(s, e - 1)]).hexdigest() for s, e in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pairs(df, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
