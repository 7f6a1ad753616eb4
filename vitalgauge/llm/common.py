"""What the operators of this folder share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch, so that a worker's memory doesn't follow the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches in this session; a smaller setting of the user's stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.  A session without one gets a temporary
    folder only where all of Spark is one process; a cluster has to name its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="vitalgauge-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/vitalgauge/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str, codec: str = "lz4") -> DataFrame:
    """The frame, written to the shared folder and read again: lineage ends here, and the
    rows outlive any executor."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The intermediate tables of one call, in one folder of the shared one, which goes when the
    block ends.  What the call returns is written elsewhere before."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, fresh(spark, label)
        self.at: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        drop_path(self.spark, self.path)

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.path}/{len(self.at)}-{label}"
        df.write.option("compression", "lz4").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing reads any more, before the block ends."""
        for df, path in self.at:
            if any(df is f for f in frames):
                drop_path(self.spark, path)


def parallelism(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and where each row's begin and end (n + 1 places).
    A null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def cut(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
