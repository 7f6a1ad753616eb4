"""A source tree as rows, and the ignore rules that thin it."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import paths
from ..parsing import brace_code, lines, python_code

EXTRACTS = "kind string, path string, language string, name string, start_byte long, start_line long, end_line long, ccn long, cognitive long, methods long, clusters long, tokens array<string>, lines array<long>, total_tests long, skipped_tests long"


def read_tree(spark: SparkSession, root: str, rules: Iterable[str] = ()) -> DataFrame:
    """path, content, language of all files under a root of any file system; hidden ones go, and those
    that ``rules`` or an ignore file of the tree ignore, of which the deeper decides."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")).where(~F.col("path").rlike(r"(^|/)\."))
    rules = [*tree_rules(spark, root), *rules]
    if rules:
        rows = rows.where(~Ignore(rules).column(F.col("path")))
    return rows.withColumn("language", paths.language(F.col("path")))


def tree_rules(spark: SparkSession, root: str) -> list[str]:
    """The rules of all ``.gitignore`` files under a root, as the root would state them, outer first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, listed = fs.makeQualified(at).toUri().getPath().rstrip("/") + "/", [], fs.listFiles(at, True)
    while listed.hasNext():
        f = listed.next().getPath()
        if f.getName() == ".gitignore":
            stream = fs.open(f)
            try:
                found.append((f.getParent().toUri().getPath().removeprefix(base.rstrip("/")).strip("/"), spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return [rebased(line, folder) for folder, text in sorted(found, key=lambda x: x[0].split("/") if x[0] else []) for line in text.splitlines()]


def rebased(rule: str, folder: str) -> str:
    """A rule of a folder's ignore file, as the root's would say it."""
    text = rule.rstrip()
    if not folder or not text or text.startswith("#"):
        return rule
    back, text = ("!", text[1:]) if text.startswith("!") else ("", text)
    inside = "/" in text.rstrip("/")
    return f"{back}/{folder}/{text.lstrip('/')}" if inside else f"{back}/{folder}/**/{text}"


def excludes(git: Iterable[str], own: Iterable[str], workspaces: dict[str, list[str]]) -> list[str]:
    """All rules in order of precedence, the last strongest: version control's, the settings', then
    each workspace's, translated to the root."""
    return [*git, *own, *(rebased(r, w) for w in sorted(workspaces) for r in workspaces[w])]


class Ignore:
    """Ignore rules as version control has them: the last that fits decides, ``!`` takes back, a
    slash inside or in front anchors, one at the end means folders, ``**`` spans folders; what
    lies in an ignored folder is ignored."""

    def __init__(self, rules: Iterable[str]):
        self.rules: list[tuple[re.Pattern[str], bool, bool]] = []
        for rule in rules:
            rule = rule.rstrip()
            if not rule or rule.startswith("#"):
                continue
            take_back = rule.startswith("!")
            rule = rule[take_back:]
            folder = rule.endswith("/")
            rule = rule.rstrip("/")
            anchored = "/" in rule
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + _pattern(rule.lstrip("/")) + r"\Z"), not take_back, folder))

    def _one(self, path: str, is_dir: bool) -> bool:
        for pattern, ignore, folder in reversed(self.rules):
            if (is_dir or not folder) and pattern.match(path):
                return ignore
        return False

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        return any(self._one("/".join(parts[:n]), True) for n in range(1, len(parts))) or self._one(path, is_dir)

    def column(self, path: Column) -> Column:
        @F.pandas_udf(BooleanType())
        def run(p: pd.Series) -> pd.Series:
            return p.map(lambda x: x is not None and self.ignored(x))

        return run(path)


def _pattern(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def workspace_rules(workspace: str, rules: Iterable[str]) -> list[str]:
    """A workspace's own rules as rules of the root."""
    out = []
    for r in rules:
        if not r.strip() or r.startswith("#"):
            out.append(r)
            continue
        mark, r = ("!", r[1:]) if r.startswith("!") else ("", r)
        out.append(f"{mark}{workspace}/{r.lstrip('/')}" if r.startswith("/") or "/" in r.rstrip("/") else f"{mark}{workspace}/**/{r}")
    return out


def extracts(files: DataFrame) -> DataFrame:
    """One pass over (path, content, language) that emits functions, classes, tokens and tests as
    rows of one schema, told apart by ``kind``; nothing is parsed twice."""

    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in EXTRACTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for path, content, language in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                p = python_code.parse(content or "") if language == "python" else brace_code.parse(content or "", language)
                base = {"path": path, "language": language}
                rows += [{**base, "kind": "function", "name": f.name, "start_byte": f.start, "start_line": f.start_line, "end_line": f.end_line, "ccn": f.ccn, "cognitive": f.cognitive} for f in p.functions]
                rows += [{**base, "kind": "class", "name": c.name, "start_line": c.start_line, "end_line": c.end_line, "methods": len(c.methods), "clusters": c.clusters} for c in p.classes]
                rows.append({**base, "kind": "tokens", "tokens": [t for t, _ in p.tokens], "lines": [n for _, n in p.tokens]})
                if p.tests:
                    rows.append({**base, "kind": "tests", "total_tests": p.tests, "skipped_tests": p.skipped})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.where(F.col("language").isNotNull()).select("path", "content", "language").mapInArrow(run, EXTRACTS)


def line_counts(files: DataFrame) -> DataFrame:
    """path, language, code, comment, blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [lines.count(c or "", k) for c, k in zip(b["content"], b["language"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "language": b["language"], **{k: [x[i] for x in n] for i, k in enumerate(("code", "comment", "blank"))}})

    return files.where(F.col("language").isNotNull()).select("path", "content", "language").mapInPandas(run, "path string, language string, code long, comment long, blank long")


def by_language(counts: DataFrame) -> DataFrame:
    return counts.groupBy("language").agg(F.count("*").alias("files"), *(F.sum(c).cast("long").alias(c) for c in ("code", "comment", "blank")))


def primary(counts: DataFrame, literate: tuple[str, ...] = lines.LITERATE) -> DataFrame:
    """One row: the language with the most code that isn't prose."""
    return by_language(counts).where(~F.col("language").isin(*literate)).orderBy(F.desc("code"), "language").limit(1).select("language")


def manifests(files: DataFrame) -> dict[str, list[str]]:
    """Declared folders of the workspaces by kind of manifest at the root: npm, pnpm, cargo, go.  A
    pattern ``folder/*`` stands for the folders below it that have a file of their own.

    files: path, content.  What comes to the driver is the root's few manifests, and of paths the
    folders that a pattern names.
    """
    root = {r["path"]: r["content"] for r in files.where(F.col("path").isin("package.json", "pnpm-workspace.yaml", "Cargo.toml", "go.work")).select("path", "content").collect()}
    said: dict[str, list[str]] = {}
    if "package.json" in root:
        given = json.loads(root["package.json"]).get("workspaces", [])
        said["npm"] = given.get("packages", []) if isinstance(given, dict) else given
    if "pnpm-workspace.yaml" in root:
        said["pnpm"] = re.findall(r"^\s*-\s*['\"]?([^'\"#\n]+?)['\"]?\s*$", root["pnpm-workspace.yaml"], re.M)
    if "Cargo.toml" in root:
        said["cargo"] = tomllib.loads(root["Cargo.toml"]).get("workspace", {}).get("members", [])
    if "go.work" in root:
        block = re.search(r"use\s*\(([^)]*)\)", root["go.work"])
        said["go"] = (block.group(1).split() if block else []) + re.findall(r"^use\s+([^\s(]+)", root["go.work"], re.M)
    out: dict[str, list[str]] = {}
    for kind, patterns in said.items():
        found: set[str] = set()
        for p in (p.removeprefix("./").rstrip("/") for p in patterns):
            if p.endswith("/*"):
                inside = files.where(F.col("path").startswith(p[:-1])).select(F.substring_index(F.expr(f"substring(path, {len(p)})"), "/", 1).alias("name"), "path")
                found |= {p[:-1] + r["name"] for r in inside.where(F.col("path") != F.concat(F.lit(p[:-1]), "name")).select("name").distinct().collect()}
            elif p and not p.startswith("!"):
                found.add(p)
        out[kind] = sorted(found)
    return {k: v for k, v in out.items() if v}
