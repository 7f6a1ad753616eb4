"""Doc pairs, snapshots and state tables on any file system Spark reads, and settings files."""

from __future__ import annotations

import json
import tomllib
import uuid
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import SCHEMA
from ..params import DEFAULT, Params

PAIRS_VERSION, SNAPSHOT_VERSION = 1, 5
PAIRS = "version long, pairs array<struct<doc:string,srcs:array<string>,confidence:double,source:string>>"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """doc, srcs, confidence, source; none from a file of another version."""
    raw = spark.read.schema(PAIRS).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return raw.where(F.col("version") == PAIRS_VERSION).select(F.explode("pairs").alias("p")).select("p.*")


def live_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """The pairs whose document and sources are all there."""
    rows = pairs.select("doc", "srcs", F.explode(F.concat(F.array("doc"), "srcs")).alias("path"))
    gone = rows.join(files.select("path"), "path", "left_anti").select("doc", "srcs").distinct()
    return pairs.join(gone, ["doc", "srcs"], "left_anti")


def write_snapshot(findings: DataFrame, path: str, head: str | None, config_hash: str, clean: bool) -> None:
    """Findings with their header in each row, as JSON lines in one folder.  They are written beside
    the old ones and take their name when they are complete."""
    stamped = findings.withColumns({"version": F.lit(SNAPSHOT_VERSION), "head_sha": F.lit(head), "config_hash": F.lit(config_hash), "worktree_clean": F.lit(clean)})
    aside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    stamped.write.json(aside)
    swap(findings.sparkSession, aside, path)


def swap(spark: SparkSession, made: str, path: str) -> None:
    """Gives a complete folder the name of another; a failure leaves the old one under its name."""
    new, at, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (made, path, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"{path} can't be replaced")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"{path} can't be replaced")
    if had:
        fs.delete(old, True)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of another version are as if they weren't there."""
    return spark.read.schema(SCHEMA + ", version int, head_sha string, config_hash string, worktree_clean boolean").json(path).where(F.col("version") == SNAPSHOT_VERSION)


def is_fresh(snapshot: DataFrame, head: str | None, config_hash: str, clean: bool) -> bool:
    """Whether a snapshot is of this commit and these settings, with nothing changed on either side."""
    first = snapshot.select("head_sha", "config_hash", "worktree_clean").first()
    return bool(first and clean and first["worktree_clean"] and first["head_sha"] == head and first["config_hash"] == config_hash)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that don't parse are left out."""
    return spark.read.schema(schema + ", bad string").option("columnNameOfCorruptRecord", "bad").json(path).where("bad is null").drop("bad")


def load_params(text: str) -> Params:
    """Settings in TOML; an unknown key is an error."""
    given = tomllib.loads(text)
    known = {f.name for f in fields(Params)}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {unknown}")
    lists = {k: tuple(v) for k, v in given.items() if isinstance(v, list)}
    over = {m: {k: tuple(v) for k, v in r.items()} for m, r in given.get("overrides", {}).items()}
    return replace(DEFAULT, **{**given, **lists, **({"overrides": over} if over else {})})


def calibration_toml(calibration: DataFrame) -> str:
    """One table for each cohort and metric; as many rows as the settings have."""
    out = ["# written by calibrate"]
    for r in calibration.orderBy("cohort", "metric").collect():
        out.append(f"\n[{json.dumps(r['cohort'] or 'global')}.{r['metric']}]")
        out += [f"{k} = {r[k]!r}" for k in ("p50", "p75", "p90", "p95", "floor_critical", "floor_ok") if r[k] is not None]
    return "\n".join(out) + "\n"
