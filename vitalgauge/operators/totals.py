"""The totals of each report: one row, by one aggregate; and the figures drawn from them.

Inputs are the reports' own columns.  A report without rows has totals of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def complexity(functions: DataFrame) -> DataFrame:
    """files (with a function), functions, max_ccn, max_cognitive of (path, ccn, cognitive)."""
    most = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
    return functions.agg(F.count_distinct("path").alias("files"), F.count("*").alias("functions"), most("ccn").alias("max_ccn"), most("cognitive").alias("max_cognitive"))


def lcom(classes: DataFrame, least: int = 2) -> DataFrame:
    """classes_scanned, classes_with_lcom (``least`` clusters or more), max_cluster_count of (clusters)."""
    return classes.agg(F.count("*").alias("classes_scanned"), F.count_if(F.col("clusters") >= least).alias("classes_with_lcom"), F.coalesce(F.max("clusters"), F.lit(0)).cast("long").alias("max_cluster_count"))


def freshness(entries: DataFrame) -> DataFrame:
    """pairs, stale_pairs of (since)."""
    return entries.agg(F.count("*").alias("pairs"), F.count_if(F.col("since") > 0).alias("stale_pairs"))


def drift(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("dangling_identifiers"))


def doc_coverage(pairs: DataFrame, missing: DataFrame) -> DataFrame:
    """tracked_srcs: sources of all pairs, one in two pairs twice; missing_docs."""
    return pairs.agg(F.coalesce(F.sum(F.size("srcs")), F.lit(0)).cast("long").alias("tracked_srcs")).crossJoin(missing.agg(F.count("*").alias("missing_docs")))  # one row each


def links(docs: DataFrame, links: DataFrame, broken: DataFrame) -> DataFrame:
    """scanned_docs, scanned_links, broken."""
    return _beside(docs.agg(F.count("*").alias("scanned_docs")), links.agg(F.count("*").alias("scanned_links")), broken.agg(F.count("*").alias("broken")))


def orphans(docs: DataFrame, orphans: DataFrame) -> DataFrame:
    return _beside(docs.agg(F.count("*").alias("scanned_docs")), orphans.agg(F.count("*").alias("orphans")))


def todo(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """scanned_docs, docs_with_markers, total_markers of (markers)."""
    return _beside(docs.agg(F.count("*").alias("scanned_docs")), entries.agg(F.count("*").alias("docs_with_markers"), F.coalesce(F.sum("markers"), F.lit(0)).cast("long").alias("total_markers")))


def duplication(blocks: DataFrame) -> DataFrame:
    """duplicate_blocks, duplicate_tokens (at all places), files_affected of (block, tokens, path), a
    row for each place."""
    return blocks.agg(F.count_distinct("block").alias("duplicate_blocks"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("duplicate_tokens"), F.count_distinct("path").alias("files_affected"))


def codebase_files(functions: DataFrame, files: DataFrame) -> DataFrame:
    """codebase_files: files with a function or counted files, whichever are more."""
    both = _beside(functions.agg(F.count_distinct("path").alias("a")), files.agg(F.count_distinct("path").alias("b")))
    return both.select(F.greatest("a", "b").alias("codebase_files"))


def counters(coverage: DataFrame, skips: DataFrame) -> DataFrame:
    """uncovered_files (under 100 %) and skipped_files (with a skipped test)."""
    return _beside(coverage.agg(F.count_if(F.col("pct") < 100).alias("uncovered_files")), skips.agg(F.count_if(F.col("skipped") > 0).alias("skipped_files")))


def coverage_ratio(coverage: DataFrame, files: DataFrame) -> DataFrame:
    """path, ratio (0 to 1) of the files asked for; null where no report has one."""
    return files.select("path").join(coverage.select("path", (F.col("pct") / 100).alias("ratio")), "path", "left")


def accepted(findings: DataFrame) -> DataFrame:
    """accepted, accepted_files of (accepted, file)."""
    return findings.agg(F.count_if("accepted").alias("accepted"), F.count_distinct(F.when(F.col("accepted"), F.col("file"))).alias("accepted_files"))


def primary_language(counts: DataFrame) -> DataFrame:
    """workspace, language: the one with most code of each workspace, of equals the first by name.
    counts: workspace, language, code."""
    by = counts.where("workspace is not null and language is not null").groupBy("workspace", "language").agg(F.sum("code").alias("code"))
    nth = F.row_number().over(Window.partitionBy("workspace").orderBy(F.desc("code"), "language"))
    return by.withColumn("nth", nth).where("nth = 1").select("workspace", "language")


def _beside(*rows: DataFrame) -> DataFrame:
    """Frames of one row each, as one row."""
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)
    return out
