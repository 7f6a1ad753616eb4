"""Exact dedup against a persistent digest index, with DataFrame operations alone.

The index is a table of digests in buckets by digest, as many as its session had shuffle
partitions when it was made; a file is sorted by digest.  A bucket that one append has filled is
read as it lies, one of several appends is sorted by the join, and neither is shuffled.  New rows are reduced to
one row a digest (before the shuffle, so a text on any number of rows is one row for
each task), held against the index with a sort-merge anti-join, and what is new is
appended under the name of its batch.  A batch that is run again under its name, since it was lost
after its append, is held against the other batches alone, gives the same rows and appends
nothing twice.  Texts are equal when identical after lower-casing A-Z alone; the digest is
the SHA-256 of that form.

Defined cases: a null text is an empty text; of equal texts the row with the largest key
stays, a null key being the smallest, and of rows that tie in that too the last one
read; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, kept

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased.  On texts that are ASCII alone lower() does that, much faster."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


class DigestIndex:
    """digest binary, keep_id long, batch string; in buckets, each sorted by digest, under ``path``.

    The folder outlives the session; a later session that opens it registers it anew, with
    the number of buckets that the folder states.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._stated(buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _stated(self, wanted: int) -> int:
        """The number in the name of a file of the folder, which readers pass over; made if missing."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(hadoop(self.path))] if fs.exists(hadoop(self.path)) else []
        stated = [int(n.removeprefix("_buckets-")) for n in names if n.startswith("_buckets-")]
        if stated:
            return stated[0]
        fs.create(hadoop(f"{self.path}/_buckets-{wanted}")).close()
        return wanted

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame, batch: str = "") -> DataFrame:
        """The groups whose digest no other batch has; the index isn't shuffled."""
        return groups.join(self.rows().where(F.col("batch") != batch).hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds what the batch hasn't added before."""
        new = groups.select("digest", "keep_id").join(self.rows().where(F.col("batch") == batch).hint("merge"), "digest", "left_anti")
        new = new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest")
        new.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)


def dedup(df: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text", number: str | None = None, batch: str | None = None) -> DataFrame:
    """One row for each row of ``df``: row_no, doc_id, keep_id, group_size, kept, text_sha256.

    group_size counts this batch.  A text that the index held before keeps that row's id
    and none of the batch.  ``batch`` names the rows, for a run that may be repeated.  row_no is the column ``number``, or numbers the rows as they were read.
    """
    row_no = F.monotonically_increasing_id() if number is None else F.col(number)
    digests = df.select(row_no.alias("row_no"), F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"))
    batch = batch or uuid.uuid4().hex
    with Scratch(df.sparkSession, "exact") as s:
        digests = s.kept(digests, "digests")
        groups = digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row_no")).alias("top"), F.count("*").alias("group_size"))
        groups = s.kept(groups.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row_no").alias("keep_row"), "group_size"), "groups")
        fresh = s.kept(index.unseen(groups, batch), "unseen")
        old = groups.join(fresh.select("digest"), "digest", "left_anti").join(index.rows().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("held_id")).hint("merge"), "digest")
        stands = s.kept(fresh.union(old.select("digest", F.col("held_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "group_size")), "stands")
        index.append(fresh, batch)
        return kept(_marked(digests, stands), "deduplicated")


def _marked(digests: DataFrame, stands: DataFrame) -> DataFrame:
    out = digests.join(stands, "digest")
    return out.select("row_no", "doc_id", "keep_id", "group_size", F.col("row_no").eqNullSafe(F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_rows(df: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.  They are numbered once and written
    with their numbers, since another scan may read them in another order."""
    mine = "row_no_of_dedup"
    numbered = kept(df.withColumn(mine, F.monotonically_increasing_id()), "numbered")
    stay = dedup(numbered, index, key, text, mine).where("kept").select(F.col("row_no").alias(mine))
    return numbered.join(stay, mine, "left_semi").drop(mine)
