"""Documentation: does it keep up, is it there, does it hang together.

commit_files(sha, path, ts); pairs(doc, srcs); docs(path, body); files(path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, paths, severity
from ..params import DEFAULT, Params


def union(*layers: DataFrame) -> DataFrame:
    """path of the documents of all layers, each once."""
    out = layers[0].select("path")
    for x in layers[1:]:
        out = out.union(x.select("path"))
    return out.distinct()


def last_change(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.max("ts").alias("doc_last"))


def freshness(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """doc, srcs, since, doc_last: how many distinct seconds saw a source change after the
    document's last change; 0 for a document without history.

    A history is reduced to its distinct seconds before it meets the pairs, and only those
    after the mark go on.
    """
    marks = pairs.select("doc", "srcs").join(last_change(changes).withColumnRenamed("path", "doc"), "doc", "left")
    wanted = marks.select("doc", "srcs", "doc_last", F.explode(F.array_distinct("srcs")).alias("path"))
    times = changes.select("path", "ts").distinct()
    newer = wanted.join(times, "path").where(F.col("ts") > F.col("doc_last")).groupBy("doc", "srcs").agg(F.count_distinct("ts").alias("since"))
    return marks.join(newer, ["doc", "srcs"], "left").select("doc", "srcs", F.coalesce("since", F.lit(0)).alias("since"), "doc_last")


def freshness_severity(since: Column, params: Params = DEFAULT) -> Column:
    return severity.ladder(since, (1, "medium"), (params.high_commits, "high"), (params.critical_commits, "critical"))


def todo_severity(count: Column, params: Params = DEFAULT) -> Column:
    return severity.ladder(count, (params.todo_medium, "medium"), (params.todo_high, "high"))


def mentions(docs: DataFrame) -> DataFrame:
    """path, line, name of what a document names in backticks."""
    return docs.select("path", F.explode(markup.names(markup.prose_of(F.col("body")))).alias("m")).select("path", "m.line", "m.name")


def drift(pairs: DataFrame, mentions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """doc, srcs, line, name of the mentions that no source of the pair defines.

    identifiers: path, name.  A qualified name is defined too if each of its parts is.
    """
    key = ["doc", "srcs"]
    named = pairs.select(*key).join(mentions.withColumnRenamed("path", "doc"), "doc")
    known = pairs.select(*key, F.explode("srcs").alias("path")).join(identifiers, "path").select(*key, "name").distinct()
    open_ = named.join(known, [*key, "name"], "left_anti")
    parts = open_.withColumn("part", F.explode(F.array_distinct(F.filter(F.split("name", "[:.]"), lambda s: s != ""))))
    found = parts.join(known.select(*key, F.col("name").alias("part"), F.lit(1).alias("one")), [*key, "part"], "left")
    missing = found.groupBy(*key, "line", "name").agg((F.count("*") - F.count("one")).alias("missing"), F.count("*").alias("parts"))
    left = missing.where("missing > 0 or parts = 1").select(*key, "line", "name")
    return open_.join(left, [*key, "line", "name"], "left_semi").select(*key, "line", "name")


def missing_docs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """src, doc: sources that are there whose document is not."""
    rows = pairs.select("doc", F.explode("srcs").alias("src"))
    rows = rows.join(files.select(F.col("path").alias("src")), "src", "left_semi")
    return rows.join(files.select(F.col("path").alias("doc")), "doc", "left_anti").select("src", "doc")


def doc_links(docs: DataFrame) -> DataFrame:
    """path, line, target of each Markdown link outside fences."""
    return docs.select("path", F.explode(markup.links(markup.prose_of(F.col("body")))).alias("l")).select("path", "l.line", "l.target")


def headings(docs: DataFrame) -> DataFrame:
    """path, anchor."""
    lines = docs.select("path", F.explode(markup.prose_of(F.col("body"))).alias("x"))
    lines = lines.where(F.col("x.text").rlike(r"^\s*#"))
    return lines.select("path", markup.slug(F.regexp_replace("x.text", r"^\s*#+\s*", "")).alias("anchor")).distinct()


def targets(links: DataFrame, skip_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``links`` that stay inside, with ``resolved`` and ``anchor``."""
    rows = links.where(~markup.is_external(F.col("target")))
    for p in skip_prefixes:
        if p:
            rows = rows.where(~F.col("target").startswith(p))
    file = F.substring_index("target", "#", 1)
    anchor = F.when(F.col("target").contains("#"), F.expr("substring(target, instr(target, '#') + 1)")).otherwise("")
    return rows.withColumns({"file": file, "anchor": anchor}).withColumn("resolved", F.when(F.col("file") == "", F.col("path")).otherwise(paths.resolve(F.col("path"), F.col("file"))))


def broken_links(links: DataFrame, files: DataFrame, headings: DataFrame, skip_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """path, line, target, kind: missing_path, or missing_anchor for an anchor of the same document.
    files: files and folders."""
    rows = targets(links, skip_prefixes)
    gone = rows.join(files.select(F.col("path").alias("resolved")), "resolved", "left_anti").select("path", "line", "target", F.lit("missing_path").alias("kind"))
    own = rows.where("file = '' and anchor <> ''").join(files.select(F.col("path").alias("resolved")), "resolved", "left_semi")
    lost = own.join(headings, ["path", "anchor"], "left_anti").select("path", "line", "target", F.lit("missing_anchor").alias("kind"))
    return gone.unionByName(lost)


def orphans(docs: DataFrame, links: DataFrame, paired: DataFrame, entry: str | None = None) -> DataFrame:
    """path of the documents that no link, pair or entry point leads to.  links: path, line,
    target of these documents; paired: path; entry: a pattern of further entry points."""
    start = F.lower(paths.basename(F.col("path"))).rlike(r"^(readme|index)\.(md|mdx|rst)$")
    if entry:
        start = start | F.col("path").rlike(entry)
    reached = targets(links).where("file <> ''").select(F.col("resolved").alias("path")).union(paired.select("path"))
    return docs.select("path").where(~start).join(reached, "path", "left_anti")


def todo_density(docs: DataFrame, markers: tuple[str, ...] = DEFAULT.markers, code_too: bool = False) -> DataFrame:
    """path, markers: how many marks of unfinished text a document has outside fences and inline code."""
    lines = docs.select("path", F.explode(markup.prose_of(F.col("body"))).alias("x")).select("path", F.col("x.text").alias("text"))
    if not code_too:  # few lines have a backtick; the rest don't leave the JVM's path in the function
        lines = lines.withColumn("text", markup.blanked("text"))
    return lines.groupBy("path").agg(F.sum(markup.marker_count(F.col("text"), markers)).cast("long").alias("markers")).where("markers > 0")
