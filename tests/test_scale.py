"""What a query costs: plans and steps whose share a task must not grow with the input."""

from __future__ import annotations

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from vitalgauge.functions import hashing
from vitalgauge.operators import churn, coupling, duplication, graphs, spread
from vitalgauge.params import Params
from vitalgauge.plans import catalogue


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def labels_of(edges) -> dict:
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        least[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(least)}


@pytest.mark.parametrize("batch", [1, 20, 1_000_000])
def test_components_in_rounds(spark, monkeypatch, batch):
    """More edges than one task solves at once: a long path, a star, random edges, lone nodes."""
    monkeypatch.setattr(graphs, "BATCH", batch)
    dice = random.Random(3)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("hub", f"s{i}") for i in range(30)] + [(f"r{dice.randrange(40)}", f"r{dice.randrange(40)}") for _ in range(30)] + [("z", "z")]
    dice.shuffle(edges)
    got = graphs.components(spark.createDataFrame([*edges, ("alone", None)], "a string, b string").repartition(3))
    assert {r["node"]: r["label"] for r in got.collect()} == labels_of([*edges, ("alone", "alone")])
    assert got.count() == len(labels_of(edges)) + 1


def test_components_of_nodes_with_equal_hashes(spark):
    """A null in a struct doesn't change its hash, so these two nodes have the same."""
    node = "struct<x:string,y:string>"
    rows = [(("k", None), ("a", "a")), ((None, "k"), ("b", "b"))]
    got = graphs.components(spark.createDataFrame(rows, f"a {node}, b {node}"))
    assert got.count() == 4 and got.select("label").distinct().count() == 2


@pytest.mark.parametrize("name", ["lcom_classes", "worst_lcom", "lcom_totals"])
def test_classes_are_dealt_out_once(spark, name):
    """One shuffle of the methods; before, components over the methods of all classes."""
    plan = plan_of(catalogue.QUERIES[name](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan parquet") == 1 and "lineitem" in plan


def test_a_class_over_several_batches(spark, monkeypatch):
    """Classes are cut between batches, never inside one; a class without a name is one, too."""
    monkeypatch.setattr(graphs, "BATCH", 3)
    links = [(s, f"m{i}", f"m{i // 4 * 4}") for s, n in (("a", 1), ("b", 9), ("c", 2), (None, 5), ("d", 16)) for i in range(n)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = graphs.clusters(spark.createDataFrame(links, "scope string, a string, b string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {tuple(r) for r in got} == {("a", 1, 1), ("b", 3, 9), ("c", 1, 2), (None, 2, 5), ("d", 4, 16)}


@pytest.mark.parametrize("name", ["churn_files", "worst_churn"])
def test_changes_are_dealt_out_before_they_are_summed(spark, monkeypatch, name):
    """As many tasks as the table asks for; before, the session's number held the sums of any input."""
    monkeypatch.setattr(spread, "TASK_BYTES", 1 << 12)
    plan = plan_of(catalogue.QUERIES[name](spark, SF))
    first = plan[plan.index("REPARTITION_BY_NUM") :]
    assert "Aggregate" not in first and "Scan parquet" in first


def test_a_commit_of_one_file_in_two_rows(spark):
    """Only changes that have one row for each commit and file may be counted as they are."""
    rows = spark.createDataFrame([("1", "a", 1, 0), ("1", "a", 2, 0), ("2", "a", 1, 1), (None, "a", 1, 0)], "sha string, path string, added long, deleted long")
    assert [tuple(r) for r in churn.churn_files(rows).collect()] == [("a", 2, 5, 1)]
    assert [tuple(r) for r in churn.churn_files(rows.where("added <> 2"), unique=True).collect()] == [("a", 2, 3, 1)]


@pytest.mark.parametrize("name", ["worst_sums", "coupling_direction", "coupling_lift", "coupling_sums", "worst_pairs", "coupling_pairs"])
def test_roles_are_asked_of_files_and_not_of_pairs(spark, name):
    """Their patterns come with the files' counts; before, the optimizer asked them of each pair before it was counted."""
    plan = plan_of(catalogue.QUERIES[name](spark, SF))
    assert "explode(slice" in plan and not any("Filter" in line and "CASE WHEN" in line for line in plan.splitlines())


def test_heads_of_commits_that_name_a_file_twice(spark):
    """A commit counts once, whatever its rows; one above the cap and rows without a commit don't count."""
    rows = [("1", "a"), ("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), (None, "a"), ("3", None), *(("4", f"f{i}") for i in range(60))]
    got = coupling.coupling(spark.createDataFrame(rows, "sha string, path string"), Params(min_coupling=1, min_lift=0.0))
    assert [tuple(r) for r in got.select("a", "b", "count", "count_a", "count_b", "lift").collect()] == [("a", "b", 2, 2, 2, 1.5)]


def test_ids_of_many_at_once(spark):
    """The hash of a batch is that of each; a function is numbered by one window for both its metrics."""
    rows = [("ccn", "a.py", "f", "ccn:1"), ("hotspot", "ü/ñ.rs", None, ""), ("ccn", None, "", None), ("x", "p" * 300, "s", "y")]
    got = spark.createDataFrame(rows, "metric string, file string, symbol string, seed string").select(hashing.finding_id(*map(F.col, ("metric", "file", "symbol", "seed"))))
    assert [r[0] for r in got.collect()] == [hashing.make_id(m, f or "", s, x or "") for m, f, s, x in rows]
    assert hashing.fnv1a_all([b"", b"ab", b"a"]).tolist() == [hashing.fnv1a(x) for x in (b"", b"ab", b"a")]
    assert plan_of(catalogue.status_findings(spark, SF)).count("Window [row_number") == 1


def test_files_are_dealt_out_as_the_input_asks(spark, monkeypatch):
    """A task's share of the labels doesn't grow with the table; before, the session's number held them."""
    monkeypatch.setattr(spread, "TASK_BYTES", 1 << 12)
    plan = plan_of(catalogue.QUERIES["file_labels"](spark, SF))
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning(file") == 1


@pytest.mark.parametrize("name", ["dup_windows", "dup_doc_pct"])
def test_windows_are_dealt_out_once(spark, name):
    """One shuffle by hash; before, sums by hash and path were moved, and then by hash."""
    plan = plan_of(catalogue.QUERIES[name](spark, SF))
    assert plan.count("Exchange hashpartitioning(h#") == 1 and "REPARTITION" in plan


def test_windows_of_a_path_in_two_rows(spark):
    """A path on two rows is one file; a file shorter than a window has no row; a path may be null."""
    rows = [("a", "x y z"), ("a", "x y q"), ("b", "x y z"), (None, "q r"), ("c", "x")]
    files = spark.createDataFrame(rows, "path string, t string").select("path", F.split("t", " ").alias("tokens"))
    assert sorted(map(tuple, duplication.shared_windows(files, 2).drop("h").collect())) == [(2, 2, "a"), (3, 2, "a")]
    assert {tuple(r) for r in duplication.shared_in_files(files, 2).collect()} == {("a", 4, 3), ("b", 2, 2), (None, 1, 0)}
