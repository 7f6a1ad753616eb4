"""Token ids as Parquet files in ascending order of doc_id, and selective reads of them.

Columns: ``doc_id``, ``part`` (the file's place in the order), ``local_start`` (ids of
the documents before it in its part), ``n_tokens``, ``ids`` (a list) and any metadata
columns asked for.  Ids are dictionary encoded, ``doc_id`` and the counts as deltas
(version 2 pages).  Row groups and pages have a stated size and page indexes are
written, so a range of documents is read without the rest, and the counts without
the ids.

Defined cases: a null text is an empty text, which has the end id alone; null ids
come first; rows with the same doc_id are all written, ordered by a hash of their
text; an empty table gives an empty set of files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism
from .encode import encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ROW_GROUP, PAGE = 32 << 20, 256 << 10


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", metadata: Sequence[str] = ()) -> None:
    """Writes the ids of every whole text, each followed by ``end_id``.

    One shuffle, by ranges of (doc_id, hash of the text), so that a doc_id on many rows
    is dealt over many parts.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"meta_{c}") for c in metadata))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(parallelism(df), *order).sortWithinPartitions(*order)
    extra = rows.schema.fields[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j, ids, n in enc.blocks(b.column(1).to_pylist()):
                size = j - i
                ends = np.cumsum(n)
                flat = np.insert(ids.astype(np.int32), ends, end_id)
                n = n + 1
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                cols = [b.column(0).slice(i, size), pa.array(np.full(size, part, np.int32)), pa.array(start + ends - n), pa.array(n), lists]
                start += int(ends[-1])
                yield pa.RecordBatch.from_arrays([*cols, *(b.column(2 + k).slice(i, size) for k in range(len(extra)))], ["doc_id", "part", "local_start", "n_tokens", "ids", *(f.name for f in extra)])

    schema = ", ".join([SCHEMA, *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])
    out = rows.mapInArrow(run, schema).write
    for k, v in {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "local_start", "n_tokens")},
    }.items():
        out = out.option(k, str(v))
    out.parquet(path)


def read_token_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, columns: Sequence[str] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The stated columns of the documents from ``first`` to ``last``; only their pages are read.

    ``start`` may be asked for: the ids of all documents before.  It needs the totals of
    the parts, a row for each file, which is the bound of what is broadcast.
    """
    rows = spark.read.parquet(path)
    if "start" in columns:
        totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
        rows = rows.join(F.broadcast(totals), "part").withColumn("start", F.col("base") + F.col("local_start"))
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select(*columns)


def checksums(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at = lists.offsets.to_numpy().tolist()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<u4")).cast("B")
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
