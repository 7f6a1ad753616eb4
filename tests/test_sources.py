"""Source trees with ignore files and manifests, snapshots that are replaced, pairs, prose."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from vitalgauge.operators import duplication, graphs, state
from vitalgauge.params import override_notes
from vitalgauge.sources import files, records


def write(root, tree):
    for path, text in tree.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_ignore_files_of_the_tree(spark, tmp_path):
    """The deeper file decides; a rule with a slash is anchored at its folder."""
    write(tmp_path, {".gitignore": "*.log\n/build\n# no rule\n", "sub/.gitignore": "!keep.log\n/only\ntmp/\n", **{p: "x" for p in ("a.py", "a.log", "build/x.py", "sub/build/y.py", "sub/keep.log", "sub/z.log", "sub/only", "sub/deep/only", "sub/deep/tmp/t.py", "tmp/t.py", "keep.log")}})
    got = sorted(r["path"] for r in files.read_tree(spark, f"file://{tmp_path}").select("path").collect())
    assert got == ["a.py", "sub/build/y.py", "sub/deep/only", "sub/keep.log", "tmp/t.py"]
    assert files.rebased("*.log", "sub") == "/sub/**/*.log" and files.rebased("!a/b", "sub") == "!/sub/a/b" and files.rebased("# x", "sub") == "# x"


def test_later_excludes_are_stronger():
    rules = files.excludes(["*.md"], ["!docs/a.md"], {"web": ["/a.ts"]})
    ignore = files.Ignore(rules)
    assert [ignore.ignored(p) for p in ("x.md", "docs/a.md", "web/a.ts", "a.ts", "web/sub/a.ts")] == [True, False, True, False, False]


def test_manifests(spark):
    tree = [("package.json", '{"workspaces": {"packages": ["packages/*", "tools/cli"]}}'), ("Cargo.toml", '[workspace]\nmembers = ["crates/*", "./xtask"]\n'), ("go.work", "go 1.22\nuse (\n\t./svc/a\n\t./svc/b\n)\nuse ./one\n"), ("pnpm-workspace.yaml", "packages:\n  - 'apps/*'\n  - \"libs/x\"\n"), ("packages/a/x.ts", ""), ("packages/b/x.ts", ""), ("packages/readme.md", ""), ("crates/core/src/lib.rs", ""), ("apps/web/i.ts", "")]
    got = files.manifests(spark.createDataFrame(tree, "path string, content string"))
    assert got == {"npm": ["packages/a", "packages/b", "tools/cli"], "pnpm": ["apps/web", "libs/x"], "cargo": ["crates/core", "xtask"], "go": ["one", "svc/a", "svc/b"]}
    assert files.manifests(spark.createDataFrame([], "path string, content string")) == {}


def test_a_snapshot_takes_the_place_of_the_old_one(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ccn")], "id string, metric string")
    path = f"file://{tmp_path}/snap"
    for head in ("one", "two"):
        records.write_snapshot(rows, path, head, "c", True)
        assert records.is_fresh(records.read_snapshot(spark, path), head, "c", True)
    assert sorted(os.listdir(tmp_path)) == ["snap"]
    assert not records.is_fresh(records.read_snapshot(spark, path), "two", "other", True)


def test_logs_and_live_pairs(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for n in (1, 2):
        records.append_log(spark.createDataFrame([(n,)], "n int"), path)
    assert sorted(r["n"] for r in records.read_log(spark, path, "n int").collect()) == [1, 2]
    pairs = spark.createDataFrame([("d1", ["s1"]), ("d2", ["s1", "gone"]), ("d3", ["s1"])], "doc string, srcs array<string>")
    there = spark.createDataFrame([("d1",), ("d2",), ("s1",)], "path string")
    assert [r["doc"] for r in records.live_pairs(pairs, there).collect()] == ["d1"]


def test_copied_prose(spark):
    """Words with their lines; a passage that two documents share is a block."""
    same = " ".join(f"word{i}" for i in range(12))
    docs = spark.createDataFrame([("a.md", f"# Title\n\n{same}\nend"), ("b.md", f"other\n{same} more"), ("c.md", None)], "path string, body string")
    tokens = duplication.prose_tokens(docs)
    assert {r["path"]: list(zip(r["tokens"], r["lines"], strict=True))[:2] for r in tokens.collect()} == {"a.md": [("title", 1), ("word0", 3)], "b.md": [("other", 1), ("word0", 2)], "c.md": []}
    found = sorted((r["path"], r["tokens"], r["start_line"]) for r in duplication.blocks(tokens, 10).collect())
    assert found == [("a.md", 12, 3), ("b.md", 12, 2)]


def test_components_of_a_long_path(spark):
    rows = [(f"n{i:03}", f"n{i + 1:03}") for i in range(150)] + [("x", "y"), ("z", "z")]
    got = {r["node"]: r["label"] for r in graphs.components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(151)}, "x": "x", "y": "x", "z": "z"}


def test_marks_and_notes(spark):
    found = spark.createDataFrame([("a", "high", 2), ("b", "ok", 0)], "id string, severity string, severity_rank int")
    table = spark.createDataFrame([("a", "was", 1), ("c", "was", 3)], "finding_id string, reason string, severity_rank int")
    assert sorted(map(tuple, state.mark_accepted(table, found, ["a", "b", "none"], "now").collect())) == [("a", "now", 2), ("b", "now", 0), ("c", "was", 3)]
    assert state.remove(table, table.where(F.col("finding_id") == "a")).count() == 1
    assert override_notes({}) == [] and override_notes({"ccn": (30.0, None)}) == ["ccn floor_critical=30 [override from 25]"]
