"""Paths as columns: parts, language, role, prefixes.  All of it stays inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "go": "go", "scala": "scala", "sc": "scala", "tsx": "tsx", "jsx": "jsx",
    **dict.fromkeys(("js", "mjs", "cjs"), "javascript"), **dict.fromkeys(("ts", "mts", "cts"), "typescript"),
}
OUTPUT_DIRS = ("__generated__", "__pycache__", "build", "dist", "generated", "node_modules", "vendor")
TEST_DIRS = ("__tests__", "spec", "test", "tests")
MANIFESTS = ("__init__.py", "index.js", "index.ts", "index.tsx", "lib.rs", "main.rs", "mod.rs")


def key(path: Column) -> Column:
    """Sorts and compares as paths do: part by part, not byte by byte."""
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)


def language(path: Column) -> Column:
    names = F.create_map([F.lit(x) for pair in sorted(LANGUAGES.items()) for x in pair])
    return names[extension(path)]


def under(path: Column, folder: Column) -> Column:
    """Whether the path is the folder or lies in it, by whole parts."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def in_dir(path: Column, *names: str) -> Column:
    return path.rlike("(^|/)(" + "|".join(names) + ")/")


def is_test(path: Column) -> Column:
    name = basename(path)
    return name.rlike(r"\.(test|spec)\.|^test_|_test\.(go|py|rs)$") | in_dir(path, *TEST_DIRS)


def is_doc(path: Column) -> Column:
    return basename(path).rlike(r"\.(md|mdx|rst)$") | in_dir(path, "docs")


def is_lockfile(path: Column) -> Column:
    return basename(path).rlike(r"\.lockb?$|^go\.sum$|^package-lock\.json$|^pnpm-lock\.yaml$")


def is_generated(path: Column, primary: str | None = None) -> Column:
    """primary: the code base's main language, which decides what ``target/`` and ``.egg-info/`` mean."""
    out = [in_dir(path, *OUTPUT_DIRS), basename(path).rlike(r"\.min\.(css|js)$|\.bundle\.|\.snap$")]
    if primary in ("rust", "scala"):
        out.append(in_dir(path, "target"))
    if primary == "python":
        out.append(path.contains(".egg-info/"))
    return _any(out)


def role(path: Column, primary: str | None = None) -> Column:
    """lockfile, generated, test, doc or source; the first that fits."""
    return (
        F.when(is_lockfile(path), "lockfile")
        .when(is_generated(path, primary), "generated")
        .when(is_test(path), "test")
        .when(is_doc(path), "doc")
        .otherwise("source")
    )


def facts(path: Column, primary: str | None = None) -> Column:
    """role, folder, manifest: what :func:`class_of` asks of a file."""
    return F.struct(role(path, primary).alias("role"), parent(path).alias("folder"), basename(path).isin(*MANIFESTS).alias("manifest"))


def pair_class(a: Column, b: Column, primary: str | None = None) -> Column:
    return class_of(facts(a, primary), facts(b, primary))


def class_of(a: Column, b: Column) -> Column:
    """What two files that change together are to each other, by their :func:`facts`.

    A module manifest is the index file of a folder; paired with one file of its folder it
    says nothing.
    """
    either = lambda r: (a["role"] == r) | (b["role"] == r)
    manifest = (a["folder"] == b["folder"]) & (a["manifest"] != b["manifest"])
    return (
        F.when(either("lockfile"), "lockfile")
        .when(either("generated"), "generated")
        .when(manifest, "manifest")
        .when(either("test"), "test_src")
        .when(either("doc"), "doc_src")
        .otherwise("genuine")
    )


def resolve(doc: Column, target: Column) -> Column:
    """A link's target as a path from the root: ``.`` and ``..`` are worked off, no further up
    than the root; a leading slash starts at the root."""
    start = F.when(target.startswith("/"), F.array().cast("array<string>")).otherwise(F.filter(F.split(parent(doc), "/"), lambda s: s != ""))
    step = lambda at, s: F.when((s == "") | (s == "."), at).when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s)))
    return F.array_join(F.aggregate(F.split(target, "/"), start, step), "/")
