"""The TPC-H-like tables, read as the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_files(spark: SparkSession, sf_dir: str, dense: bool = False, by: tuple[str, ...] = ("sha", "path")) -> DataFrame:
    """An order as a commit, its parts (or suppliers, which all meet often) as files; a row for each
    commit and file.  ``by``: the columns whose rows are in one task (rows hardly repeat, so they are
    dealt out before they are summed, not after)."""
    path = F.concat(F.lit("s/" if dense else "p/"), F.col("l_suppkey" if dense else "l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sha"), path.alias("path"), F.unix_timestamp("l_shipdate").alias("t"), F.floor("l_quantity").alias("q"), F.col("l_linenumber").alias("n"))
    return spread(rows, *by).groupBy("sha", "path").agg(F.min("t").alias("ts"), F.sum("q").cast("long").alias("added"), F.sum("n").cast("long").alias("deleted"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("path"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("name"),
        F.floor("l_quantity").cast("long").alias("ccn"),
        F.floor(F.col("l_quantity") * F.col("l_tax") * 10).cast("long").alias("cognitive"),
        F.concat(F.lit("n"), (F.col("l_suppkey") % 5).cast("string")).alias("cohort"),
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("path")).agg(F.count("*").alias("lines_found"), F.count_if(F.col("l_linestatus") == "F").alias("lines_hit"))


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("path")).agg(F.count("*").alias("total_tests"), F.count_if(F.col("l_returnflag") == "R").alias("skipped_tests"))


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a customer's document (finished orders) and of its source (the others)."""
    o = table(spark, sf_dir, "orders")
    side = F.when(F.col("o_orderstatus") == "F", "docs/").otherwise("src/")
    return o.select(F.col("o_orderkey").cast("string").alias("sha"), F.concat(side, F.col("o_custkey").cast("string")).alias("path"), F.unix_timestamp("o_orderdate").alias("ts"))


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("docs/"), key).alias("doc"), F.array(F.concat(F.lit("src/"), key)).alias("srcs"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.col("text").alias("body"), "doc_id")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("target"))


def snapshot(spark: SparkSession, sf_dir: str, until: str, shift: int = 0) -> DataFrame:
    """Findings of the customers' orders up to a day."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(until).cast("timestamp"))
    rows = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rank = F.greatest(F.lit(0), F.least(F.floor((F.col("n") + shift) / 4), F.lit(3))).cast("int")
    sev = F.element_at(F.array(*map(F.lit, ("ok", "medium", "high", "critical"))), rank + 1)
    return rows.select(
        F.concat(F.lit("ccn:c/"), F.col("o_custkey").cast("string")).alias("id"), F.lit("ccn").alias("metric"), sev.alias("severity"), rank.alias("severity_rank"),
        (F.col("n") % 2 == 0).alias("hotspot"), (F.col("o_custkey") % 7 == 0).alias("accepted"),
    )
