"""Two snapshots against each other, and the tables of fixed, accepted and regressed findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import findings as fd


def _last(findings: DataFrame) -> DataFrame:
    """One row an id: the last of the order it is given in, else the largest."""
    order = ["seq"] if "seq" in findings.columns else [c for c in ("severity_rank", "metric", "hotspot") if c in findings.columns]
    w = Window.partitionBy("id").orderBy(*(F.desc(c) for c in order))
    return findings.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, metric, from_/to_ severity, hotspot and accepted, bucket: resolved, regressed, improved,
    unchanged or new.  Rows: id, metric, severity, severity_rank, hotspot, accepted."""
    side = lambda df, p: _last(df).select("id", *(F.col(c).alias(f"{p}_{c}") for c in ("metric", "severity", "severity_rank", "hotspot", "accepted")))
    both = side(before, "from").join(side(after, "to"), "id", "full_outer")
    old, new = F.col("from_severity_rank"), F.col("to_severity_rank")
    bucket = F.when(new.isNull(), "resolved").when(old.isNull(), "new").when(new > old, "regressed").when(new < old, "improved").otherwise("unchanged")
    return both.select("id", F.coalesce("to_metric", "from_metric").alias("metric"), "from_severity", "to_severity", "from_hotspot", "to_hotspot", "from_accepted", "to_accepted", bucket.alias("bucket"))


def progress(entries: DataFrame) -> DataFrame:
    """One row: total, resolved, progress, t0_total, t0_resolved, t0_progress.  The first tier is that
    of the earlier side, without what was accepted there."""
    t0 = (fd.tier(F.col("metric"), F.col("from_severity"), F.col("from_hotspot")) == "must") & ~F.coalesce("from_accepted", F.lit(False))
    rows = entries.where("bucket <> 'new'").withColumn("t0", F.coalesce(t0, F.lit(False)))
    out = rows.agg(F.count("*").alias("total"), F.count_if(F.col("bucket") == "resolved").alias("resolved"), F.count_if("t0").alias("t0_total"), F.count_if(F.col("t0") & (F.col("bucket") == "resolved")).alias("t0_resolved"))
    part = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return out.select("*", part("resolved", "total").alias("progress"), part("t0_resolved", "t0_total").alias("t0_progress"))


def visible(entries: DataFrame, show_all: bool = False, hide_accepted: bool = False) -> DataFrame:
    out = entries
    if hide_accepted:
        out = out.where(~F.coalesce("to_accepted", "from_accepted", F.lit(False)))
    if not show_all:
        out = out.where(F.coalesce(F.col("from_severity").isin("high", "critical"), F.lit(False)) | F.coalesce(F.col("to_severity").isin("high", "critical"), F.lit(False)))
    return out


def hidden(entries: DataFrame) -> DataFrame:
    """One row: entries that :func:`visible` leaves out for their severity."""
    return entries.agg(F.count("*").alias("all")).crossJoin(visible(entries).agg(F.count("*").alias("shown"))).select((F.col("all") - F.col("shown")).alias("hidden"))  # one row each


def ordered(entries: DataFrame) -> DataFrame:
    """Entries with ``nth``, their place in their bucket by id."""
    return entries.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("id")))


def payload(entries: DataFrame) -> DataFrame:
    """bucket, id, json: each entry as one JSON object, fields without a value left out."""
    fields = ["id", "metric", "from_severity", "to_severity", "from_hotspot", "to_hotspot"]
    return entries.select("bucket", "id", F.to_json(F.struct(*fields)).alias("json"))


def reconcile_fixed(fixed: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixed entries that are found again, and those that stay fixed.  fixed: finding_id, ..."""
    ids = findings.select(F.col("id").alias("finding_id")).distinct()
    return fixed.join(ids, "finding_id", "left_semi"), fixed.join(ids, "finding_id", "left_anti")


def escalated(accepted: DataFrame, findings: DataFrame) -> DataFrame:
    """Accepted findings that are worse than when they were accepted.  accepted: finding_id, severity_rank."""
    was = accepted.select(F.col("finding_id").alias("id"), F.col("severity_rank").alias("was_rank"))
    return findings.join(was, "id").where(F.col("severity_rank") > F.col("was_rank"))


def upsert(table: DataFrame, changes: DataFrame, key: str = "finding_id") -> DataFrame:
    """The table with the changes' rows in place of its own of the same key."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def remove(table: DataFrame, keys: DataFrame, key: str = "finding_id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def mark_fixed(fixed: DataFrame, findings: DataFrame, ids: list[str], commit: str) -> DataFrame:
    """The table of fixed findings (finding_id, commit_sha, severity) with these findings put in or renewed."""
    rows = findings.where(F.col("id").isin(ids)).select(F.col("id").alias("finding_id"), F.lit(commit).alias("commit_sha"), "severity")
    return upsert(fixed, rows)


def mark_accepted(accepted: DataFrame, findings: DataFrame, ids: list[str], reason: str) -> DataFrame:
    """The table of accepted findings (finding_id, reason, severity_rank) with these put in or renewed."""
    rows = findings.where(F.col("id").isin(ids)).select(F.col("id").alias("finding_id"), F.lit(reason).alias("reason"), "severity_rank")
    return upsert(accepted, rows)


def nudge(findings: DataFrame) -> DataFrame:
    """One row: how many hot files have too little coverage and weren't accepted."""
    bad = (F.col("metric") == "coverage_pct") & (F.col("severity_rank") >= 2) & F.col("hotspot") & ~F.col("accepted")
    return findings.agg(F.count_if(bad).alias("uncovered_hotspots"))
