"""A repository's history as rows.  The log is read once on the driver, line by line, into files
that Spark then parses; a history that is kept as Parquet skips this step."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMAT = "%x01%H%x02%P%x02%ct%x02%ae%x02%s"


def write_log(root: str, to: str) -> None:
    """First-parent diffs without rename detection, newest first."""
    with open(to, "w", encoding="utf-8") as out:
        subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", "log", "--no-renames", "--numstat", "--diff-merges=first-parent", f"--format={_FORMAT}"], stdout=out, check=True)


def head(root: str) -> str | None:
    got = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True)
    return got.stdout.strip() or None if got.returncode == 0 else None


def clean(root: str) -> bool:
    return not subprocess.run(["git", "-C", root, "status", "--porcelain"], capture_output=True, text=True).stdout.strip()


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """commits(sha, parent_sha, ts, author_email, subject) and commit_files(sha, path, ts, added,
    deleted).  A record begins with a byte that no line has, so each is read whole and the
    parts of a log can be read side by side."""
    raw = spark.read.option("lineSep", "\x01").text(path).where("value <> ''")
    parts = F.split(F.substring_index("value", "\n", 1), "\x02")
    rows = raw.select(parts[0].alias("sha"), F.substring_index(parts[1], " ", 1).alias("parent_sha"), parts[2].cast("long").alias("ts"), parts[3].alias("author_email"), parts[4].alias("subject"), F.split("value", "\n").alias("lines"))
    commits = rows.select("sha", F.nullif("parent_sha", F.lit("")).alias("parent_sha"), "ts", "author_email", "subject")
    files = rows.select("sha", "ts", F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line")).where(F.col("line").contains("\t"))
    f = F.split("line", "\t")
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0))  # noqa: E731  binary files have "-"
    files = files.withColumns({"a": f[0], "d": f[1], "path": f[2]})
    return commits, files.select("sha", "path", "ts", number("a").alias("added"), number("d").alias("deleted"))
