"""Test coverage and skipped tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("lines_found", "lines_hit", "branches_found", "branches_hit")


def parse_lcov(reports: DataFrame) -> DataFrame:
    """source, path and the four counters of each record of (source, text).

    Records follow one another in a report; each line's record is the count of ``SF`` lines up
    to it, kept inside the report's row, so reports are independent and nothing is sorted
    across them.  A stated total wins over counted lines; unknown lines count for nothing.
    """
    lines = reports.select("source", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("source").orderBy("pos")
    lines = lines.withColumn("line", F.trim("line")).withColumn("rec", F.sum(F.col("line").startswith("SF:").cast("int")).over(w)).where("rec > 0")
    ended = F.max((F.col("line") == "end_of_record").cast("int")).over(Window.partitionBy("source", "rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0")
    tag, rest = F.substring_index("line", ":", 1), F.expr("substring(line, instr(line, ':') + 1)")
    lines = lines.select("source", "rec", tag.alias("tag"), rest.alias("rest"))
    number = lambda t: F.max(F.when(F.col("tag") == t, F.expr("try_cast(rest as bigint)")))
    hits = lambda t, i: F.when(F.col("tag") == t, F.coalesce(F.expr(f"try_cast(split(rest, ',')[{i}] as bigint)"), F.lit(0)))
    found = lambda t: F.count_if(F.col("tag") == t)
    out = lines.groupBy("source", "rec").agg(
        F.max(F.when(F.col("tag") == "SF", F.col("rest"))).alias("path"),
        F.coalesce(number("LF"), found("DA")).alias("lines_found"),
        F.coalesce(number("LH"), F.count_if(hits("DA", 1) > 0)).alias("lines_hit"),
        F.coalesce(number("BRF"), found("BRDA")).alias("branches_found"),
        F.coalesce(number("BRH"), F.count_if(hits("BRDA", 3) > 0)).alias("branches_hit"),
    )
    return out.select("source", "path", *COUNTERS)


def merge(records: DataFrame) -> DataFrame:
    """path, counters, pct: the largest of each counter over all records of a file; a file without
    lines is wholly covered."""
    out = records.groupBy("path").agg(*(F.max(c).cast("long").alias(c) for c in COUNTERS if c in records.columns))
    return out.withColumn("pct", F.when(F.col("lines_found") == 0, 100.0).otherwise(F.lit(100.0) * F.col("lines_hit") / F.col("lines_found")))


def locate(records: DataFrame, files: DataFrame) -> DataFrame:
    """Paths as the root has them: a record's path, or the first of the folders above its report,
    from the report up, under which there is such a file; else the path as it stands."""
    above = F.expr("transform(sequence(size(split(source, '/')) - 1, 0, -1), n -> array_join(slice(split(source, '/'), 1, n), '/'))")
    key = records.select("source", "path").distinct()
    tried = F.concat(F.array("path"), F.transform(above, lambda u: F.when(u == "", F.col("path")).otherwise(F.concat(u, F.lit("/"), F.col("path")))))
    hit = key.select("source", "path", F.posexplode(tried).alias("nth", "at")).join(files.select(F.col("path").alias("at")), "at", "left_semi").groupBy("source", "path").agg(F.min(F.struct("nth", "at")).alias("best"))
    return records.join(hit, ["source", "path"], "left").select(*[c for c in records.columns if c != "path"], F.coalesce("best.at", "path").alias("path"))


def skip_ratio(tests: DataFrame) -> DataFrame:
    """path, total, skipped, pct of (path, total_tests, skipped_tests); files without tests go."""
    out = tests.groupBy("path").agg(F.sum("total_tests").cast("long").alias("total"), F.sum("skipped_tests").cast("long").alias("skipped")).where("total > 0")
    return out.withColumn("pct", F.lit(100.0) * F.col("skipped") / F.col("total"))
