"""Findings: the rows that all metrics end in, their ids, marks and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, paths, severity
from ..params import DEFAULT, Params, policy_for
from .spread import spread

LOCATION = "struct<file:string,line:int,symbol:string>"
SCHEMA = (
    f"id string, metric string, severity string, severity_rank int, hotspot boolean, workspace string, location {LOCATION}, "
    f"locations array<{LOCATION}>, summary string, fix_hint string, accepted boolean, is_test_file boolean, value double"
)
DOCS = ("doc_coverage", "doc_drift", "doc_freshness", "doc_hotspot", "doc_link_health", "orphan_pages", "todo_density")
TESTS = ("change_coupling.drift", "coverage_pct", "skip_ratio", "test_hotspot")
ORDER = ("ccn", "cognitive", "duplication", "change_coupling", "hotspot", "lcom", "doc_freshness", "doc_drift", "doc_coverage", "doc_link_health", "orphan_pages", "todo_density", "doc_hotspot", "coverage_pct", "skip_ratio", "test_hotspot")


def family(metric: Column) -> Column:
    return F.when(metric.isin(*DOCS), "docs").when(metric.isin(*TESTS), "test").otherwise("code")


def place(file: Column, line: Column | None = None, symbol: Column | None = None) -> Column:
    return F.struct(file.alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line"), (F.lit(None) if symbol is None else symbol).cast("string").alias("symbol"))


def make(rows: DataFrame, metric: Column, file: Column, seed: Column, summary: Column, value: Column, severity_: Column, line: Column | None = None, symbol: Column | None = None, locations: Column | None = None) -> DataFrame:
    """Finding rows of a report; ``severity_`` is a severity name."""
    name = F.lit(None).cast("string") if symbol is None else symbol
    none = F.array().cast(f"array<{LOCATION}>")
    return rows.select(
        hashing.finding_id(metric, file, name, seed).alias("id"),
        metric.alias("metric"),
        severity_.alias("severity"),
        severity.rank(severity_).alias("severity_rank"),
        F.lit(False).alias("hotspot"),
        F.lit(None).cast("string").alias("workspace"),
        place(file, line, name).alias("location"),
        (none if locations is None else locations).alias("locations"),
        summary.alias("summary"),
        F.lit(None).cast("string").alias("fix_hint"),
        F.lit(False).alias("accepted"),
        F.lit(False).alias("is_test_file"),
        value.cast("double").alias("value"),
    )


def ordinals(rows: DataFrame, by: list[str], order: list[str], base: Column) -> DataFrame:
    """Adds ``seed``: the base, and ``:n`` for the n-th repeat of the same key."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("seed", F.when(n == 0, base).otherwise(F.concat(base, F.lit(":"), n.cast("string"))))


def run_labels(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """key, run, label, n: neighbours with the same label as one."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(1))
    runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy(key, "run", label).agg(F.count("*").alias("n"))


def decorate(findings: DataFrame, hot: DataFrame) -> DataFrame:
    """Sets ``hotspot`` where the place, or one of the places, of a finding is hot in its own
    family.  hot: family, path.

    Whether a finding is hot follows from its family and its places alone, so those are the
    key: the few hot paths meet each distinct set of places by one semi-join.
    """
    rows = findings.withColumns({"fam": family(F.col("metric")), "places": F.array_distinct(F.concat(F.array("location.file"), F.col("locations.file")))})
    at = rows.select("fam", "places").distinct().withColumn("path", F.explode("places"))
    yes = at.join(hot.select(F.col("family").alias("fam"), "path").distinct(), ["fam", "path"], "left_semi").select("fam", "places").distinct().withColumn("yes", F.lit(True))
    out = rows.join(yes, ["fam", "places"], "left").withColumn("hotspot", F.coalesce("yes", F.lit(False)))
    return out.select(*findings.columns)


def tag_tests(findings: DataFrame) -> DataFrame:
    return findings.withColumn("is_test_file", paths.is_test(F.col("location.file")))


def accept(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Sets ``accepted`` where an acceptance has the finding's id."""
    marks = accepted.select(F.col("finding_id").alias("id"), F.lit(True).alias("yes")).distinct()
    return findings.join(marks, "id", "left").withColumn("accepted", F.coalesce("yes", F.lit(False))).select(*findings.columns)


def tier(metric: Column, severity_: Column, hotspot: Column, metrics: tuple[str, ...] = ORDER, params: Params = DEFAULT) -> Column:
    """must, should, advisory, or null for ok.  Rules are settings, so they are an expression."""

    def rules(name: str) -> Column:
        policy = policy_for(params, name)
        fits = lambda specs: F.lit(False) if not specs else _any([(severity_ == s) & (hotspot if h else F.lit(True)) for s, h in specs])
        parked = name == "change_coupling.cross_workspace" and name not in params.overrides
        return F.lit("advisory") if parked else F.when(fits(policy["must"]), "must").when(fits(policy["should"]), "should").otherwise("advisory")

    own = {*params.overrides, "change_coupling.cross_workspace"}
    out = rules("")
    for name in sorted(own, key=lambda n: ("." in n, n)):
        fit = metric == name if "." in name else (metric == name) | metric.startswith(name + ".")
        out = F.when(fit, rules(name)).otherwise(out)
    return F.when(severity_ == "ok", F.lit(None).cast("string")).otherwise(out)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def drain_summary(findings: DataFrame) -> DataFrame:
    """One row: findings and files of the first two tiers, without accepted findings."""
    live = findings.where(~F.col("accepted"))
    t = tier(F.col("metric"), F.col("severity"), F.col("hotspot"))
    live = live.select(t.alias("tier"), F.col("location.file").alias("file"))
    return live.agg(*(c for k in ("must", "should") for c in (F.count_if(F.col("tier") == k).alias(k), F.count_distinct(F.when(F.col("tier") == k, F.col("file"))).alias(f"{k}_files"))))


def select_metric(findings: DataFrame, name: str) -> DataFrame:
    """By a metric's name; ``complexity`` is both its metrics and ``coupling`` the pairs that count."""
    names = {"complexity": ["ccn", "cognitive"], "coupling": ["change_coupling", "change_coupling.symmetric", "change_coupling.drift"]}.get(name, [name])
    return findings.where(F.col("metric").isin(names))


def narrow(findings: DataFrame, workspace: str | None = None, prefix: str | None = None, least: str = "ok", fam: str | None = None) -> DataFrame:
    out = findings.where(F.col("severity_rank") >= ("ok", "medium", "high", "critical").index(least))
    if workspace is not None:
        out = out.where(F.col("workspace") == workspace)
    if prefix:
        out = out.where(F.col("location.file").startswith(prefix))
    if fam:
        out = out.where(family(F.col("metric")) == fam)
    return out


# The words before a number in a summary, and the labels of what has none.
NUMBERED = {"ccn": ("CCN", ""), "cognitive": ("Cognitive", ""), "lcom": ("LCOM", ""), "coverage_pct": ("Coverage", "%"), "skip_ratio": ("Skip", "%")}
LABELS = {
    "change_coupling": "coupled", "change_coupling.symmetric": "coupled (sym)", "change_coupling.cross_workspace": "coupled (cross-ws)",
    "change_coupling.expected": "coupled (expected)", "change_coupling.drift": "coupled (drift)",
}


def leading_number(metric: Column, summary: Column) -> Column:
    """The number that a summary of a counting metric begins with, else null."""
    out = F.lit(None).cast("double")
    for name, (word, _) in NUMBERED.items():
        out = F.when(metric == name, F.nullif(F.regexp_extract(summary, f"^{word}=([0-9]+)", 1), F.lit("")).cast("double")).otherwise(out)
    return out


def short_label(metric: Column, summary: Column) -> Column:
    """A few letters for a finding in a list: its number, or its kind."""
    out = metric
    for name, label in LABELS.items():
        out = F.when(metric == name, label).otherwise(out)
    for name, (word, unit) in NUMBERED.items():
        digits = F.regexp_extract(summary, f"^{word}=([0-9]+)", 1)
        out = F.when(metric == name, F.when(digits == "", word).otherwise(F.concat(F.lit(f"{word}="), digits, F.lit(unit)))).otherwise(out)
    return out


def worst_first() -> list[Column]:
    """The order of a list of findings: severity, hot ones, metric, file; then the id, so that it is total."""
    return [F.desc("severity_rank"), F.desc("hotspot"), F.asc("metric"), paths.key(F.col("location.file")), F.asc("id")]


def sections(findings: DataFrame, top: int | None = None) -> DataFrame:
    """Findings with ``nth`` in their tier, worst first, and how many the tier has; at most ``top`` of
    each tier.  Findings without a tier are in no section."""
    shown = findings.where("tier is not null")
    sizes = shown.groupBy("tier").agg(F.count("*").alias("in_tier"))  # a row a tier
    out = shown.withColumn("nth", F.row_number().over(Window.partitionBy("tier").orderBy(*worst_first())))
    out = out if top is None else out.where(F.col("nth") <= top)
    return out.join(F.broadcast(sizes), "tier")


def file_labels(findings: DataFrame) -> DataFrame:
    """file, labels: a line for each file of a section, equal neighbours as ``label(n)``."""
    label = short_label(F.col("metric"), F.col("summary"))
    rows = spread(findings.select(F.col("location.file").alias("file"), label.alias("label"), "severity_rank", "hotspot", "metric", "id", "summary"), "file")
    order = [F.desc("severity_rank"), F.desc("hotspot"), F.asc("metric"), F.asc("id"), F.asc("summary")]  # worst first in one file
    rows = rows.select("file", "label", F.row_number().over(Window.partitionBy("file").orderBy(*order)).alias("at"))
    runs = run_labels(rows, "file", "at", "label")
    one = F.when(F.col("n") > 1, F.concat("label", F.lit("("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("label"))
    return runs.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", one.alias("text")))), lambda x: x["text"]), "  ").alias("labels"))


def overlaid(findings: DataFrame, accepted: DataFrame, fixed: DataFrame) -> DataFrame:
    """Findings without those that are marked as fixed and are not back; accepted ones are marked."""
    return accept(findings, accepted).join(fixed.select(F.col("finding_id").alias("id")).distinct(), "id", "left_anti")
