"""Breaks of each metric from the code base's own distribution, and severities from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity
from ..params import FALLBACK, FLOORS, MIN_SAMPLES

BREAKS = ("p50", "p75", "p90", "p95")
GLOBAL = ""


def _const(metric: Column, table: dict[str, float | None]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in table.items():
        if value is not None:
            out = F.when(metric == name, F.lit(float(value))).otherwise(out)
    return out


def calibrate(values: DataFrame, floors: dict[str, tuple[float | None, float | None]] = FLOORS, fallback: dict[str, tuple[float, ...]] = FALLBACK) -> DataFrame:
    """cohort, metric, n, p50, p75, p90, p95, floor_critical, floor_ok of (cohort, metric, value).

    Exact percentiles with linear interpolation, over a count of each distinct value, so what
    one task holds follows the distinct values.  Values that are no finite number don't
    count; under five there are no breaks but the fallback's.
    """
    good = values.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    counted = good.groupBy("cohort", "metric", "value").agg(F.count("*").alias("times"))
    out = counted.groupBy("cohort", "metric").agg(F.sum("times").cast("long").alias("n"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9), F.lit(0.95)), F.col("times")).alias("q"))
    metric = F.col("metric")
    cols = [F.when(F.col("n") >= MIN_SAMPLES, F.col("q")[i]).otherwise(_const(metric, {m: v[i] for m, v in fallback.items()})).alias(b) for i, b in enumerate(BREAKS)]
    return out.select("cohort", "metric", "n", *cols, _const(metric, {m: v[0] for m, v in floors.items()}).alias("floor_critical"), _const(metric, {m: v[1] for m, v in floors.items()}).alias("floor_ok"))


def override(calibration: DataFrame, floors: dict[tuple[str, str], tuple[float | None, float | None]]) -> DataFrame:
    """Settings' floors by (cohort, metric) in place of the calibrated ones; what is None stays."""
    out = calibration
    for (cohort, metric), values in sorted(floors.items()):
        here = (F.col("cohort") == cohort) & (F.col("metric") == metric)
        for name, v in zip(("floor_critical", "floor_ok"), values, strict=True):
            if v is not None:
                out = out.withColumn(name, F.when(here, F.lit(float(v))).otherwise(F.col(name)))
    return out


def classified(values: DataFrame, calibration: DataFrame) -> DataFrame:
    """``values`` (cohort, metric, value, ...) with severity and severity_rank.

    A cohort that has any breaks uses its own alone (a metric it lacks is ok); any other uses
    the global ones.  A calibration has a row for each cohort and metric of the settings.
    """
    own = calibration.select(F.col("cohort").alias("c"), F.col("metric").alias("m"), *BREAKS, "floor_critical", "floor_ok")
    known = calibration.select(F.col("cohort").alias("k")).distinct()
    rows = values.join(F.broadcast(known), values["cohort"] == F.col("k"), "left").withColumn("using", F.coalesce("k", F.lit(GLOBAL)))
    out = rows.join(F.broadcast(own), (F.col("using") == F.col("c")) & (F.col("metric") == F.col("m")), "left")
    out = out.withColumn("severity", severity.classify(F.col("value"), *(F.col(b) for b in BREAKS), F.col("floor_critical"), F.col("floor_ok")))
    return out.select(*values.columns, "severity", severity.rank(F.col("severity")).alias("severity_rank"))


def flag_hot(scores: DataFrame, calibration: DataFrame, metric: str = "hotspot") -> DataFrame:
    """``scores`` (path, score, ...) with hot, from the global breaks of the metric."""
    one = calibration.where((F.col("cohort") == GLOBAL) & (F.col("metric") == metric)).select(F.col("p90").alias("b90"), F.col("floor_ok").alias("bok"))
    out = scores.join(F.broadcast(one), F.lit(True), "left")
    return out.select(*scores.columns, severity.hot(F.col("score"), F.col("b90"), F.col("bok")).alias("hot"))


def severity_counts(findings: DataFrame, by: str | None = None) -> DataFrame:
    """critical, high, medium, ok; findings that were accepted don't count, but by workspace they
    do, and findings of no workspace don't."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "ok")]
    if by:
        return findings.where(F.col(by).isNotNull()).groupBy(by).agg(*counts)
    return findings.where(~F.coalesce("accepted", F.lit(False))).agg(*counts)
