"""How often files change.  Input: commit_files(sha, path, ts, added, deleted)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def window(changes: DataFrame, as_of: int, since_days: int) -> DataFrame:
    """Changes from ``since_days`` before ``as_of`` (epoch seconds) on, the first second included."""
    return changes.where(F.col("ts") >= as_of - since_days * 86_400)


def churn_files(changes: DataFrame, unique: bool = False) -> DataFrame:
    """path, commits, added, deleted.  ``unique``: the changes have one row for each commit and file,
    so none need be held against the others."""
    commits = F.count("sha") if unique else F.count_distinct("sha")
    return changes.groupBy("path").agg(commits.alias("commits"), F.sum("added").cast("long").alias("added"), F.sum("deleted").cast("long").alias("deleted"))


def churn_totals(changes: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """One row: files, commits, added, deleted.  ``commits`` (sha) is all commits of the window,
    those without a file too; without it only those that touch a file count."""
    out = changes.agg(F.count_distinct("path").alias("files"), F.count_distinct("sha").alias("commits"), F.coalesce(F.sum("added"), F.lit(0)).cast("long").alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).cast("long").alias("deleted"))
    if commits is None:
        return out
    return out.drop("commits").crossJoin(commits.agg(F.count_distinct("sha").alias("commits"))).select("files", "commits", "added", "deleted")  # one row each


def assign_workspace(rows: DataFrame, workspaces: list[str], path: str = "path") -> DataFrame:
    """Adds ``workspace``: the longest declared one that the path lies in, or null.  The declared
    list is settings, so it is an expression and not a join."""
    out = F.lit(None).cast("string")
    for w in sorted(workspaces, key=len):
        out = F.when(paths.under(F.col(path), F.lit(w)), w).otherwise(out)
    return rows.withColumn("workspace", out)
