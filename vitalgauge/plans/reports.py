"""Queries on what is drawn from the reports: totals, orders, sections, marks, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import churn, coverage, docs, findings, graphs, hotspots, ranking, state, totals
from ..operators.spread import spread
from ..params import override_notes as notes
from ..sources import tables
from . import catalogue as c
from .catalogue import CF, CHURN, CLASSIFIED, COV, DIFF, FN, FRESH, HOT, NEW, OLD, PAIRS, SNAP, TEST_HOT, query, rounded, values


@query(f"WITH {FN} SELECT count(DISTINCT path) files, count(*) functions, max(ccn) max_ccn, max(cognitive) max_cognitive FROM fn")
def complexity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.complexity(tables.functions(spark, sf_dir))


CLASSES = "cl AS (SELECT CAST(l_orderkey AS VARCHAR) scope, count(DISTINCT l_returnflag || l_linestatus) clusters, count(*) methods FROM lineitem GROUP BY 1)"


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a class: its lines are methods, and those of the same two flags share a field."""
    line = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("scope"), F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("method"), F.concat("l_returnflag", "l_linestatus").alias("field"))
    first = F.min("method").over(Window.partitionBy("scope", "field"))
    return graphs.clusters(spread(line, "scope").select("scope", F.when(F.col("field").isNull(), F.col("method")).otherwise(first).alias("a"), F.col("method").alias("b")))


@query(f"WITH {CLASSES} SELECT * FROM cl")
def lcom_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir)


@query(f"WITH {CLASSES} SELECT count(*) classes_scanned, count(*) FILTER (clusters >= 2) classes_with_lcom, max(clusters) max_cluster_count FROM cl")
def lcom_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.lcom(_classes(spark, sf_dir))


@query(f"WITH {CLASSES} SELECT scope path, clusters, methods FROM cl ORDER BY clusters DESC, string_split(scope, '/') LIMIT 5")
def worst_lcom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classes(spark, sf_dir).select(F.col("scope").alias("path"), "clusters", "methods", F.col("scope").alias("name"))
    return ranking.worst(rows, "lcom", 5).drop("name")


@query(f"WITH {FRESH} SELECT count(*) pairs, count(*) FILTER (since > 0) stale_pairs FROM fr")
def freshness_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.freshness(c._fresh(spark, sf_dir))


@query(f"WITH {FRESH} SELECT doc, since FROM fr ORDER BY since DESC, string_split(doc, '/') LIMIT 5")
def worst_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(c._fresh(spark, sf_dir), "freshness", 5).select("doc", "since")


@query(f"""WITH {FRESH}, p AS (SELECT DISTINCT path FROM ch), f2 AS (SELECT doc, since FROM fr WHERE doc IN (SELECT path FROM p) AND replace(doc, 'docs/', 'src/') IN (SELECT path FROM p)) SELECT * FROM f2""")
def live_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs whose files are all there."""
    from ..sources import records

    changes = tables.histories(spark, sf_dir)
    pairs = records.live_pairs(tables.doc_pairs(spark, sf_dir), changes.select("path").distinct())
    return docs.freshness(pairs, changes).select("doc", "since")


DRIFT = """m AS (SELECT 'docs/' || CAST(o_custkey AS VARCHAR) doc, CAST(o_orderkey AS BIGINT) line, 'n' || CAST(o_orderkey % 97 AS VARCHAR) "name" FROM orders),
known AS (SELECT DISTINCT 'docs/' || CAST(o_custkey AS VARCHAR) doc, 'n' || CAST(o_orderkey % 89 AS VARCHAR) "name" FROM orders), dr AS (SELECT * FROM m ANTI JOIN known USING (doc, "name") WHERE doc IN (SELECT 'docs/' || CAST(c_custkey AS VARCHAR) FROM customer))"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    named = o.select(F.concat(F.lit("docs/"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").cast("long").alias("line"), F.concat(F.lit("n"), (F.col("o_orderkey") % 97).cast("string")).alias("name"))
    known = o.select(F.concat(F.lit("src/"), F.col("o_custkey").cast("string")).alias("path"), F.concat(F.lit("n"), (F.col("o_orderkey") % 89).cast("string")).alias("name"))
    return docs.drift(tables.doc_pairs(spark, sf_dir), named, known)


@query(f'WITH {DRIFT} SELECT doc, line, "name" FROM dr')
def drift_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("doc", "line", "name")


@query(f"WITH {DRIFT} SELECT count(*) dangling_identifiers FROM dr")
def drift_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.drift(_drift(spark, sf_dir))


@query(f"WITH {DRIFT} SELECT doc, line, \"name\" FROM dr ORDER BY string_split(doc, '/'), line, \"name\" LIMIT 5")
def worst_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(_drift(spark, sf_dir), "drift", 5).select("doc", "line", "name")


@query(f"SELECT (SELECT count(*) FROM customer) tracked_srcs, count(*) missing_docs FROM ({c.SQL['doc_coverage']})")
def doc_coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.doc_coverage(tables.doc_pairs(spark, sf_dir), c.doc_coverage(spark, sf_dir))


@query(f"SELECT src FROM ({c.SQL['doc_coverage']}) ORDER BY string_split(src, '/') LIMIT 5")
def worst_missing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(c.doc_coverage(spark, sf_dir), "missing_docs", 5).select("src")


WEB = """d AS (SELECT 'w/' || CAST(c_custkey AS VARCHAR) || '.md' path, CAST(1 AS BIGINT) line, './' || CAST((c_custkey * 7) % 5000 AS VARCHAR) || '.md' target, 'w/' || CAST((c_custkey * 7) % 5000 AS VARCHAR) || '.md' resolved FROM customer),
b AS (SELECT path, line, target FROM d WHERE resolved NOT IN (SELECT path FROM d)), orph AS (SELECT path FROM d WHERE path NOT IN (SELECT resolved FROM d))"""


def _web(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document for each customer, with a link to another in a line of its text."""
    key = F.col("c_custkey").cast("long")
    to = (key * 7 % 5000).cast("string")
    body = F.concat(F.lit("see [the next]("), F.lit("./"), to, F.lit(".md)\n```\n[no](./none.md)\n```\n"))
    pages = tables.table(spark, sf_dir, "customer").select(F.concat(F.lit("w/"), key.cast("string"), F.lit(".md")).alias("path"), body.alias("body"))
    return pages, docs.doc_links(pages)


@query(f"WITH {WEB} SELECT path, line, target, 'missing_path' kind FROM b")
def link_health_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, links = _web(spark, sf_dir)
    return docs.broken_links(links, pages.select("path"), docs.headings(pages))


@query(f"WITH {WEB} SELECT (SELECT count(*) FROM d) scanned_docs, (SELECT count(*) FROM d) scanned_links, (SELECT count(*) FROM b) broken")
def link_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, links = _web(spark, sf_dir)
    return totals.links(pages, links, docs.broken_links(links, pages.select("path"), docs.headings(pages)))


@query(f"WITH {WEB} SELECT path, line, target FROM b ORDER BY string_split(path, '/'), line, target LIMIT 5")
def worst_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(link_health_pages(spark, sf_dir), "links", 5).select("path", "line", "target")


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages, links = _web(spark, sf_dir)
    return pages, docs.orphans(pages, links, spark.createDataFrame([], "path string"))


@query(f"WITH {WEB} SELECT path FROM orph")
def orphan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)[1]


@query(f"WITH {WEB} SELECT (SELECT count(*) FROM d) scanned_docs, (SELECT count(*) FROM orph) orphans")
def orphan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.orphans(*_orphans(spark, sf_dir))


@query(f"WITH {WEB} SELECT path FROM orph ORDER BY string_split(path, '/') LIMIT 5")
def worst_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(orphan_documents(spark, sf_dir), "orphans", 5)


@query(f"SELECT (SELECT count(*) FROM documents) scanned_docs, count(*) docs_with_markers, CAST(sum(markers) AS BIGINT) total_markers FROM ({c.SQL['todo_density']})")
def todo_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.todo(tables.docs(spark, sf_dir), c.todo_density(spark, sf_dir))


@query(f"SELECT path, markers FROM ({c.SQL['todo_density']}) ORDER BY markers DESC, string_split(path, '/') LIMIT 5")
def worst_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(c.todo_density(spark, sf_dir), "todo", 5)


BLOCKS = "bl AS (SELECT l_partkey AS block, 50 + l_partkey % 7 AS tokens, 'o/' || CAST(l_orderkey AS VARCHAR) AS path, CAST(l_linenumber AS BIGINT) AS start_line FROM lineitem)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as a copied block, in each order that has it."""
    line = tables.table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").alias("block"), (50 + F.col("l_partkey") % 7).alias("tokens"), F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").cast("long").alias("start_line"))


@query(f"WITH {BLOCKS} SELECT count(DISTINCT block) duplicate_blocks, CAST(sum(tokens) AS BIGINT) duplicate_tokens, count(DISTINCT path) files_affected FROM bl")
def duplication_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.duplication(_blocks(spark, sf_dir))


@query(f"WITH {BLOCKS} SELECT tokens, path, start_line FROM bl ORDER BY tokens DESC, string_split(path, '/'), start_line LIMIT 5")
def worst_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(_blocks(spark, sf_dir), "duplication", 5).select("tokens", "path", "start_line")


@query(f"WITH {BLOCKS}, t AS (SELECT 'o/' || CAST(o_orderkey AS VARCHAR) path, CAST(300 AS BIGINT) total FROM orders) SELECT path, total, least(total, CAST(coalesce(sum(tokens), 0) AS BIGINT)) duplicated, round(100.0::DOUBLE * least(total, coalesce(sum(tokens), 0)) / total, 6) pct FROM t LEFT JOIN bl USING (path) GROUP BY path, total")
def duplication_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import duplication

    files = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), F.array_repeat(F.lit("x"), 300).alias("tokens"))
    return duplication.rollup(files, _blocks(spark, sf_dir)).select("path", "total", "duplicated", rounded("pct"))


@query(f"WITH {FN}, {CF} SELECT greatest((SELECT count(DISTINCT path) FROM fn), (SELECT count(DISTINCT path) FROM cf)) codebase_files")
def codebase_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.codebase_files(tables.functions(spark, sf_dir), tables.commit_files(spark, sf_dir))


@query(f"WITH {COV} SELECT (SELECT count(*) FROM cov WHERE pct < 100) uncovered_files, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_returnflag = 'R') skipped_files")
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.counters(c._coverage(spark, sf_dir), coverage.skip_ratio(tables.tests(spark, sf_dir)))


@query(f"WITH {COV} SELECT 'p/' || CAST(p_partkey AS VARCHAR) path, round(pct / 100, 6) ratio FROM part LEFT JOIN cov ON cov.path = 'p/' || CAST(p_partkey AS VARCHAR)")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"))
    return totals.coverage_ratio(c._coverage(spark, sf_dir), parts).select("path", rounded("ratio"))


@query(f"WITH b AS ({SNAP.format(until=NEW[0], shift=0)}) SELECT count(*) FILTER (acc) accepted, count(DISTINCT id) FILTER (acc) accepted_files FROM b")
def accepted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.accepted(tables.snapshot(spark, sf_dir, NEW[0]).withColumn("file", F.expr("substring(id, 5)")))


@query("""WITH g AS (SELECT source workspace, lang "language", sum(n_chars) code FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY code DESC, "language") k FROM g) SELECT workspace, "language" FROM r WHERE k = 1""")
def primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.primary_language(tables.table(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), F.col("lang").alias("language"), F.col("n_chars").alias("code")))


@query(f"WITH {CF} SELECT count(DISTINCT path) files, (SELECT count(*) FROM orders) commits, CAST(sum(added) AS BIGINT) added, CAST(sum(deleted) AS BIGINT) deleted FROM cf")
def churn_totals_all_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits without a file count too."""
    return churn.churn_totals(tables.commit_files(spark, sf_dir), tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sha")))


FOUND = f"""{CLASSIFIED}, f AS (SELECT metric || ':' || path || ':' || "name" id, metric, severity, CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END severity_rank,
  length("name") % 2 = 0 hotspot, path file, CASE metric WHEN 'ccn' THEN 'CCN=' ELSE 'Cognitive=' END || CAST(CAST("value" AS BIGINT) AS VARCHAR) || ' ' || "name" || ' (sql)' summary FROM s),
t AS (SELECT *, CASE WHEN severity = 'ok' THEN NULL WHEN severity = 'critical' AND hotspot THEN 'must' WHEN severity = 'critical' OR (severity = 'high' AND hotspot) THEN 'should' ELSE 'advisory' END tier FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY severity_rank DESC, hotspot DESC, metric, string_split(file, '/'), id) nth, count(*) OVER (PARTITION BY tier) in_tier FROM t WHERE tier IS NOT NULL)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import severity

    rows = c._classified(spark, sf_dir)
    word = F.when(F.col("metric") == "ccn", "CCN=").otherwise("Cognitive=")
    rows = rows.select(
        F.concat_ws(":", "metric", "path", "name").alias("id"), "metric", "severity", severity.rank(F.col("severity")).alias("severity_rank"), (F.length("name") % 2 == 0).alias("hotspot"),
        F.struct(F.col("path").alias("file")).alias("location"), F.concat(word, F.col("value").cast("long").cast("string"), F.lit(" "), F.col("name"), F.lit(" (sql)")).alias("summary"), F.lit(False).alias("accepted"),
    )
    return rows.withColumn("tier", findings.tier(F.col("metric"), F.col("severity"), F.col("hotspot")))


@query(f"{FOUND} SELECT tier, nth, in_tier, id FROM o WHERE nth <= 20")
def status_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst 20 of each tier, in order."""
    return findings.sections(_findings(spark, sf_dir), 20).select("tier", F.col("nth").cast("long").alias("nth"), "in_tier", "id")


@query(f"""{FOUND} SELECT id, CASE metric WHEN 'ccn' THEN 'CCN=' ELSE 'Cognitive=' END || regexp_extract(summary, '=([0-9]+)', 1) label, CAST(regexp_extract(summary, '=([0-9]+)', 1) AS DOUBLE) "value" FROM f""")
def finding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short labels, and the numbers that summaries begin with."""
    rows = _findings(spark, sf_dir)
    m, s = F.col("metric"), F.col("summary")
    return rows.select("id", findings.short_label(m, s).alias("label"), findings.leading_number(m, s).alias("value"))


@query(f"""{FOUND}, l AS (SELECT file, CASE metric WHEN 'ccn' THEN 'CCN=' ELSE 'Cognitive=' END || regexp_extract(summary, '=([0-9]+)', 1) label, row_number() OVER (PARTITION BY file ORDER BY severity_rank DESC, hotspot DESC, metric, id, summary) k FROM f),
a AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY file ORDER BY k) = label THEN 0 ELSE 1 END fresh FROM l), b AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY k) run FROM a),
g AS (SELECT file, run, label || CASE WHEN count(*) > 1 THEN '(' || CAST(count(*) AS VARCHAR) || ')' ELSE '' END x FROM b GROUP BY file, run, label) SELECT file, string_agg(x, '  ' ORDER BY run) labels FROM g GROUP BY file""")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of labels for each file, equal neighbours as one."""
    return findings.file_labels(_findings(spark, sf_dir))


@query(f"{FOUND} SELECT id FROM f WHERE severity_rank >= 2 AND starts_with(file, 'p/1')")
def narrowed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.narrow(_findings(spark, sf_dir), prefix="p/1", least="high", fam="code").select("id")


@query(f"{FOUND}, n AS (SELECT * FROM f WHERE file = 'p/1' OR starts_with(file, 'p/1/')) SELECT 'p/1' workspace, count(*) FILTER (severity = 'critical') critical, count(*) FILTER (severity = 'high') high, count(*) FILTER (severity = 'medium') medium, count(*) FILTER (severity = 'ok') ok FROM n")
def workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the findings that are left when one workspace is asked for."""
    from ..operators import calibration

    rows = churn.assign_workspace(_findings(spark, sf_dir).withColumn("path", F.col("location.file")), ["p/1", "p/2"])
    return calibration.severity_counts(findings.narrow(rows, workspace="p/1"), "workspace")


@query(f"{FOUND} SELECT id, hash_ac accepted FROM (SELECT id, CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) % 5 = 0 hash_ac, CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) % 7 = 0 fx FROM f) WHERE NOT fx")
def status_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted findings are marked, fixed ones are not shown."""
    rows = _findings(spark, sf_dir)
    number = F.regexp_extract("location.file", "([0-9]+)", 1).cast("long")
    ids = lambda n: rows.where(number % n == 0).select(F.col("id").alias("finding_id"))
    return findings.overlaid(rows, ids(5), ids(7)).select("id", "accepted")


@query(f"{DIFF} SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY id) nth FROM d")
def diff_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ordered(state.diff(*c._sides(spark, sf_dir))).select("id", "bucket", F.col("nth").cast("long").alias("nth"))


@query(f"{DIFF} SELECT count(*) FILTER (NOT (coalesce(o, 0) >= 2 OR coalesce(n, 0) >= 2)) hidden FROM d")
def diff_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.hidden(state.diff(*c._sides(spark, sf_dir)))


LEVEL = "['ok', 'medium', 'high', 'critical']"


@query(f"""{DIFF}, j AS (SELECT d.id, bucket, '{{"id":"' || d.id || '","metric":"ccn"' || CASE WHEN o IS NULL THEN '' ELSE ',"from_severity":"' || {LEVEL}[o + 1] || '"' END || CASE WHEN n IS NULL THEN '' ELSE ',"to_severity":"' || {LEVEL}[n + 1] || '"' END
  || CASE WHEN h IS NULL THEN '' ELSE ',"from_hotspot":' || CAST(h AS VARCHAR) END || CASE WHEN b.hot IS NULL THEN '' ELSE ',"to_hotspot":' || CAST(b.hot AS VARCHAR) END || '}}' json FROM d LEFT JOIN b USING (id)) SELECT bucket, id, json FROM j""")
def diff_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.payload(state.diff(*c._sides(spark, sf_dir)))


@query(f"WITH b AS ({SNAP.format(until=NEW[0], shift=0)}) SELECT count(*) FILTER (hot AND NOT acc AND r >= 2) uncovered_hotspots FROM b")
def nudge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.nudge(tables.snapshot(spark, sf_dir, NEW[0]).withColumn("metric", F.lit("coverage_pct")))


MARKED = "('ccn:c/1', 'ccn:c/4', 'ccn:c/7', 'ccn:c/8', 'ccn:c/none')"
IDS = ["ccn:c/1", "ccn:c/4", "ccn:c/7", "ccn:c/8", "ccn:c/none"]


@query(f"WITH a AS ({SNAP.format(until=OLD[0], shift=0)}), b AS ({SNAP.format(until=NEW[0], shift=0)}) SELECT id finding_id, 'old' reason, r severity_rank FROM a WHERE acc AND NOT (id IN {MARKED} AND id IN (SELECT id FROM b)) UNION ALL SELECT id, 'new', r FROM b WHERE id IN {MARKED}")
def mark_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = tables.snapshot(spark, sf_dir, OLD[0]).where("accepted").select(F.col("id").alias("finding_id"), F.lit("old").alias("reason"), "severity_rank")
    return state.mark_accepted(was, tables.snapshot(spark, sf_dir, NEW[0]), IDS, "new")


@query(f"WITH a AS ({SNAP.format(until=OLD[0], shift=0)}), b AS ({SNAP.format(until=NEW[0], shift=0)}) SELECT id finding_id, 'c0' commit_sha, {LEVEL}[r + 1] severity FROM a WHERE acc AND NOT (id IN {MARKED} AND id IN (SELECT id FROM b)) UNION ALL SELECT id, 'c1', {LEVEL}[r + 1] FROM b WHERE id IN {MARKED}")
def mark_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = tables.snapshot(spark, sf_dir, OLD[0]).where("accepted").select(F.col("id").alias("finding_id"), F.lit("c0").alias("commit_sha"), "severity")
    return state.mark_fixed(was, tables.snapshot(spark, sf_dir, NEW[0]), IDS, "c1")


@query(f"WITH a AS ({SNAP.format(until=OLD[0], shift=0)}) SELECT id finding_id FROM a WHERE acc AND id NOT IN {MARKED}")
def unmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = tables.snapshot(spark, sf_dir, OLD[0]).where("accepted").select(F.col("id").alias("finding_id"))
    return state.remove(was, spark.createDataFrame([(i,) for i in IDS], "finding_id string"))


@query(values([("ccn floor_ok=9 [override from 11]",), ("cognitive floor_critical=60 [override from 50]",)], "note"))
def override_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in notes({"ccn": (25.0, 9.0), "cognitive": (60.0, None)})], "note string")


@query("SELECT DISTINCT 'd/' || CAST(doc_id % 500 AS VARCHAR) path FROM documents UNION SELECT 'd/' || CAST(doc_id % 700 AS VARCHAR) FROM documents")
def doc_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of both layers, each once."""
    d = tables.table(spark, sf_dir, "documents")
    layer = lambda n: d.select(F.concat(F.lit("d/"), (F.col("doc_id") % n).cast("string")).alias("path"))
    return docs.union(layer(500), layer(700))


@query(f"WITH {CF}, {PAIRS}, q AS (SELECT * FROM c WHERE \"count\" >= 2 AND lift >= 2), u AS (SELECT path, CAST(sum(\"count\") AS BIGINT) \"sum\" FROM (SELECT a path, \"count\" FROM q UNION ALL SELECT b, \"count\" FROM q) GROUP BY path) SELECT path, \"sum\" FROM u ORDER BY \"sum\" DESC, string_split(path, '/') LIMIT 5")
def worst_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(c.coupling_sums(spark, sf_dir), "sums", 5)


@query(f"SELECT path, pct FROM ({c.SQL['skip_ratio']}) WHERE skipped > 0 ORDER BY pct DESC, string_split(path, '/') LIMIT 5")
def worst_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(c.skip_ratio(spark, sf_dir), "skip_ratio", 5).select("path", "pct")


@query(f"SELECT path, score FROM ({TEST_HOT}) ORDER BY score DESC, string_split(path, '/') LIMIT 5")
def worst_test_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(c.test_hotspot(spark, sf_dir), "test_hotspot", 5).select("path", "score")


@query(f"SELECT doc, score FROM ({c.SQL['doc_hotspot']}) ORDER BY score DESC, string_split(doc, '/') LIMIT 5")
def worst_doc_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(c.doc_hotspot(spark, sf_dir), "doc_hotspot", 5).select("doc", "score")


@query('SELECT lang "language", CAST(sum(n_chars) AS BIGINT) code FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY code DESC, lang LIMIT 3')
def worst_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").where("lang is not null").groupBy(F.col("lang").alias("language")).agg(F.sum("n_chars").cast("long").alias("code"))
    return ranking.worst(rows, "loc", 3)
