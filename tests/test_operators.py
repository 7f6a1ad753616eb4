"""Operators on small frames with results worked out by hand."""

from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from vitalgauge.functions import markup, paths, severity
from vitalgauge.functions.hashing import config_hash, make_id, record_id
from vitalgauge.operators import calibration, churn, coupling, coverage, docs, duplication, findings, graphs, hotspots, state
from vitalgauge.params import DEFAULT, Params, drain_spec, policy_for
from vitalgauge.parsing import brace_code, lines, python_code
from vitalgauge.sources import files, git, records


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def changes(spark, commits):
    return spark.createDataFrame([(str(i), p, i, 1, 0) for i, c in enumerate(commits) for p in c], "sha string, path string, ts long, added long, deleted long")


def test_pairs_and_sums(spark):
    cf = changes(spark, [["a", "b", "c"]] * 3 + [["a", "b"]] * 2 + [["a", "c"]])
    pairs = coupling.coupling(cf, Params(min_coupling=1, min_lift=0.0))
    assert rows(pairs.select("a", "b", "count")) == [("a", "b", 5), ("a", "c", 4), ("b", "c", 3)]
    assert rows(coupling.sums(pairs)) == [("a", 9), ("b", 8), ("c", 7)]


def test_bulk_commits_and_empty_history(spark):
    cf = changes(spark, [[f"f{i}" for i in range(60)], ["a", "b"]])
    assert rows(coupling.capped(cf)) == [("1", "a"), ("1", "b")]
    assert coupling.coupling(cf.limit(0)).count() == 0


@pytest.mark.parametrize(("given", "wanted"), [((5, 5, 5, 10), 2.0), ((5, 50, 50, 100), 0.2), ((0, 0, 0, 0), float("inf"))])
def test_lift(spark, given, wanted):
    got = spark.range(1).select(coupling.lift(*map(F.lit, given)).alias("x")).first()["x"]
    assert got == pytest.approx(wanted)


def test_paths_sort_by_parts(spark):
    got = spark.createDataFrame([("a-b",), ("a/b",)], "p string").orderBy(paths.key(F.col("p"))).collect()
    assert [r["p"] for r in got] == ["a/b", "a-b"]


def test_hotspots(spark):
    ch = spark.createDataFrame([("a", 10), ("b", 2), ("c", 1)], "path string, commits long")
    fn = spark.createDataFrame([("a", 5), ("a", 5), ("b", 20), ("d", 9)], "path string, ccn long")
    assert rows(hotspots.hotspot(ch, fn).select("path", "score")) == [("a", 100.0), ("b", 40.0)]
    cov = spark.createDataFrame([("a", 80.0)], "path string, pct double")
    got = dict(rows(hotspots.test_hotspot(ch.where("path <> 'c'"), cov).select("path", "score")))
    assert got == {"a": pytest.approx(200.0), "b": 200.0}


@pytest.mark.parametrize(("commits", "since"), [([["d", "s"], ["s"], ["s"], ["s"]], 3), ([["s"], ["s"], ["d"]], 0), ([["d"], ["s", "t"], ["s"]], 2)])
def test_freshness(spark, commits, since):
    pairs = spark.createDataFrame([("d", ["s", "t"])], "doc string, srcs array<string>")
    assert docs.freshness(pairs, changes(spark, commits)).first()["since"] == since


def test_freshness_ladder(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 4, 5, 19, 20, 100)], "n long").select("n", docs.freshness_severity(F.col("n")).alias("s")).orderBy("n").collect()
    assert [r["s"] for r in got] == ["ok", "medium", "medium", "high", "high", "critical", "critical"]


def test_percentiles_interpolate(spark):
    v = spark.createDataFrame([("", "m", float(x)) for x in (1, 2, 3, 4, 5)] + [("", "m", float("nan"))], "cohort string, metric string, value double")
    got = calibration.calibrate(v).first()
    assert (got["n"], got["p50"], got["p75"]) == (5, 3.0, 4.0)


def test_cohorts_fall_back_whole(spark):
    cal = spark.createDataFrame([("", "ccn", 25.0), ("", "lcom", 2.0), ("w", "ccn", 5.0)], "cohort string, metric string, floor_critical double")
    cal = cal.select("*", *(F.lit(None).cast("double").alias(c) for c in ("p50", "p75", "p90", "p95", "floor_ok")))
    v = spark.createDataFrame([("w", "ccn", 9.0), ("w", "lcom", 9.0), ("x", "lcom", 9.0)], "cohort string, metric string, value double")
    assert rows(calibration.classified(v, cal).select("cohort", "metric", "severity")) == [("w", "ccn", "critical"), ("w", "lcom", "ok"), ("x", "lcom", "critical")]


def test_hot_flag(spark):
    got = spark.createDataFrame([(50.0,), (67.0,), (200.0,)], "s double").select(severity.hot(F.col("s"), F.lit(67.0), F.lit(22.0)).alias("h")).collect()
    assert [r["h"] for r in got] == [False, True, True]


def test_tiers():
    assert drain_spec("high:hotspot") == ("high", True)
    for bad in ("hot", "high:", "high:cold"):
        with pytest.raises(ValueError, match="no drain rule"):
            drain_spec(bad)
    over = Params(overrides={"change_coupling": {"must": ("high",)}})
    assert policy_for(over, "change_coupling.drift")["must"] == (("high", False),)
    assert policy_for(over, "ccn")["must"] == (("critical", True),)


def test_drain_tier_column(spark):
    given = [("ccn", "critical", True), ("ccn", "critical", False), ("ccn", "high", True), ("ccn", "high", False), ("ccn", "ok", True), ("change_coupling.cross_workspace", "critical", True)]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, m string, s string, h boolean")
    got = df.select("i", findings.tier(F.col("m"), F.col("s"), F.col("h"), params=DEFAULT).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == ["must", "should", "should", "advisory", None, "advisory"]


def test_ids():
    assert make_id("ccn", "src/hot.rs", "tangled", "ccn:70") == "ccn:src/hot.rs:tangled:4cee502791250124"
    assert make_id("change_coupling", "src/cold.rs", "src/hot.rs", "pair").endswith("fed17bf9c3d281b0")
    assert len(record_id("h", config_hash(b"a", b"b"), True)) == 16
    assert record_id("h", "c", True) != record_id("h", "c", False)


def test_findings_and_decoration(spark):
    r = spark.createDataFrame([("a.rs", "f", 30), ("b.rs", "g", 3)], "path string, name string, ccn long")
    f = findings.make(r, F.lit("ccn"), F.col("path"), F.concat(F.lit("ccn:"), F.col("ccn")), F.col("name"), F.col("ccn"), F.lit("high"), symbol=F.col("name"))
    hot = spark.createDataFrame([("code", "a.rs"), ("docs", "b.rs")], "family string, path string")
    assert rows(findings.decorate(f, hot).select("location.file", "hotspot", "severity_rank")) == [("a.rs", True, 2), ("b.rs", False, 2)]


def test_diff_is_a_partition(spark):
    cols = "id string, metric string, severity string, severity_rank int, hotspot boolean, accepted boolean"
    old = spark.createDataFrame([(i, "ccn", "x", r, True, False) for i, r in (("a", 1), ("b", 1), ("c", 3), ("d", 2))], cols)
    new = spark.createDataFrame([(i, "ccn", "x", r, True, False) for i, r in (("a", 1), ("b", 2), ("c", 1), ("e", 0))], cols)
    assert rows(state.diff(old, new).select("id", "bucket")) == [("a", "unchanged"), ("b", "regressed"), ("c", "improved"), ("d", "resolved"), ("e", "new")]
    assert state.progress(state.diff(old.limit(0), new.limit(0))).first()["progress"] == 0.0


def test_upsert_and_remove(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "finding_id string, v int")
    n = spark.createDataFrame([("b", 3), ("c", 4)], "finding_id string, v int")
    assert rows(state.upsert(t, n)) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(state.remove(t, n)) == [("a", 1)]


def test_markdown_scanners():
    assert markup.line_links('[a](x.md "t") ![i](p.png) \\[e](n.md) [b](y.md)') == ["x.md", "y.md"]
    assert markup.without_code("a `b` ``c`d`` e `f") == "a" + " " * 13 + "e" + " " * 3
    assert len(markup.without_code("a `b` c")) == 7
    assert "b" not in markup.without_code("a `b` c")
    assert markup.inline_names("`Alive` and `deadbeef1` and `a-b` ``x `y` `` `Foo::bar`") == ["Alive", "Foo::bar"]


def test_greedy_blocks():
    a, b = list("xyzabcdefgh"), list("qabcdefr")
    assert duplication.greedy([a, b], 4) == [(6, [(0, 3), (1, 1)])]
    assert duplication.greedy([[], list("ab")], 4) == []


def test_cohesion(spark):
    m = spark.createDataFrame([("A", x) for x in "abc"] + [("B", "a")], "scope string, method string")
    e = spark.createDataFrame([("A", "a", "b")], "scope string, a string, b string")
    assert rows(graphs.cohesion(m, e)) == [("A", 2, 3), ("B", 1, 1)]


def test_lcov_merge(spark):
    r = spark.createDataFrame([("l", "SF:a\nLF:10\nLH:6\nend_of_record\nSF:a\nLF:10\nLH:8\nend_of_record\nSF:b\nend_of_record\n")], "source string, text string")
    assert rows(coverage.merge(coverage.parse_lcov(r)).select("path", "lines_hit", "pct")) == [("a", 8, 80.0), ("b", 0, 100.0)]


def test_locate_coverage(spark):
    r = spark.createDataFrame([("pkg/web/cov/lcov.info", "src/a.ts", 1)], "source string, path string, lines_found long")
    f = spark.createDataFrame([("pkg/web/src/a.ts",)], "path string")
    assert coverage.locate(r, f).first()["path"] == "pkg/web/src/a.ts"


@pytest.mark.parametrize(("language", "source", "ccn", "cognitive"), [
    ("typescript", "function f(a, b) { if (a && b) {} for (const x of b) {} return a ? 1 : 2; }", 5, 4),
    ("rust", "fn n(a: bool) { if a { if a { if a { x(); } } } }", 4, 6),
    ("go", "func n(a bool) { if a { } else if a { } else { } }", 3, 3),
])
def test_complexity(language, source, ccn, cognitive):
    f = brace_code.parse(source, language).functions[0]
    assert (f.ccn, f.cognitive) == (ccn, cognitive)


def test_python_complexity_and_classes():
    p = python_code.parse("class C:\n  def a(self): return self.x\n  def b(self): self.x = 1\n  def c(self): pass\n")
    assert (p.classes[0].clusters, len(p.classes[0].methods)) == (2, 3)
    assert python_code.parse("def broken(:").functions == []
    nested = python_code.parse("def f(a):\n if a:\n  if a:\n   if a:\n    pass\n").functions[0]
    assert (nested.ccn, nested.cognitive) == (4, 6)


def test_line_counts():
    assert lines.count("# a\n\nx = 1\n", "python") == (1, 1, 1)
    assert lines.count("/* a\n b */\nx();\n", "rust") == (1, 2, 0)


def test_ignore_rules():
    ig = files.Ignore(["*.log", "!keep.log", "/build", "vendor/", "docs/**/tmp"])
    assert [ig.ignored(p) for p in ("a/b.log", "a/keep.log", "build/x", "a/build", "a/vendor/x.py", "docs/a/b/tmp", "src/x.py")] == [True, False, True, False, True, True, False]
    assert files.workspace_rules("pkg/web", ["vendor/", "/x", "!y"]) == ["pkg/web/**/vendor/", "pkg/web/x", "!pkg/web/**/y"]


def test_git_history(spark, tmp_path):
    def run(*a):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)

    run("init", "-q")
    for i, names in enumerate((["a.py", "b.py"], ["a.py"])):
        for n in names:
            (tmp_path / n).write_text(f"x = {i}\n")
        run("add", "-A")
        run("commit", "-qm", f"step {i}")
    log = tmp_path.parent / "history.txt"
    git.write_log(str(tmp_path), str(log))
    commits, cf = git.read_log(spark, str(log))
    assert commits.count() == 2
    assert rows(churn.churn_files(cf)) == [("a.py", 2, 2, 1), ("b.py", 1, 1, 0)]
    assert git.clean(str(tmp_path))
    assert len(git.head(str(tmp_path))) == 40
    tree = files.read_tree(spark, str(tmp_path), ["b.py"])
    assert rows(tree.select("path", "language")) == [("a.py", "python")]


def test_records(spark, tmp_path):
    (tmp_path / "pairs.json").write_text('{"version": 1, "pairs": [{"doc": "d.md", "srcs": ["a.rs"], "confidence": 0.9, "source": "manual"}]}')
    assert records.read_pairs(spark, str(tmp_path / "pairs.json")).first()["doc"] == "d.md"
    (tmp_path / "new.json").write_text('{"version": 999, "pairs": []}')
    assert records.read_pairs(spark, str(tmp_path / "new.json")).count() == 0
    assert records.load_params("since_days = 30\nmust = ['high']").must == ("high",)
    with pytest.raises(ValueError, match="unknown"):
        records.load_params("since_dayz = 3")
    r = spark.createDataFrame([("a.rs", 30)], "path string, ccn long")
    f = findings.make(r, F.lit("ccn"), F.col("path"), F.lit("s"), F.lit("x"), F.col("ccn"), F.lit("high"))
    records.write_snapshot(f, str(tmp_path / "snap"), "h", "c", True)
    snap = records.read_snapshot(spark, str(tmp_path / "snap"))
    assert records.is_fresh(snap, "h", "c", True)
    assert not records.is_fresh(snap, "h", "c", False)


def test_stream_equals_batch(spark, tmp_path):
    from vitalgauge.streaming import churn as stream

    cf = changes(spark, [["a", "b"], ["a"]]).withColumn("ts", (F.col("ts") + 1) * 86_400)
    src = str(tmp_path / "in")
    cf.write.parquet(src)
    late = changes(spark, [["z"]]).withColumn("ts", F.lit(90 * 86_400))
    late.write.mode("append").parquet(src)
    stream.run_once(stream.read(spark, src), str(tmp_path / "out"), str(tmp_path / "state"))
    stream.run_once(stream.read(spark, src), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("path").agg(F.sum("changes").alias("n"))
    assert rows(got.where("path <> 'z'")) == [("a", 2), ("b", 1)]
