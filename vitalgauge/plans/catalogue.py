"""Every operator as a query over the given tables, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, paths
from ..operators import calibration, churn, coupling, coverage, docs, duplication, findings, graphs, hotspots, ranking, state
from ..params import Params
from ..sources import tables
from . import lowering

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c), digits).alias(c)


CF = """cf AS (SELECT CAST(l_orderkey AS VARCHAR) sha, 'p/' || CAST(l_partkey AS VARCHAR) path,
  CAST(epoch(min(l_shipdate)) AS BIGINT) ts, CAST(sum(floor(l_quantity)) AS BIGINT) added, CAST(sum(l_linenumber) AS BIGINT) deleted
  FROM lineitem GROUP BY 1, 2)"""
DENSE = CF.replace("'p/' || CAST(l_partkey", "'s/' || CAST(l_suppkey")
CHURN = "churn AS (SELECT path, count(DISTINCT sha) commits, CAST(sum(added) AS BIGINT) added, CAST(sum(deleted) AS BIGINT) deleted FROM cf GROUP BY path)"
FN = """fn AS (SELECT 'p/' || CAST(l_partkey AS VARCHAR) path, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) "name",
  CAST(floor(l_quantity) AS BIGINT) ccn, CAST(floor(l_quantity * l_tax * 10) AS BIGINT) cognitive, 'n' || CAST(l_suppkey % 5 AS VARCHAR) cohort FROM lineitem)"""
COV = """cov AS (SELECT 'p/' || CAST(l_partkey AS VARCHAR) path, count(*) lines_found, count(*) FILTER (l_linestatus = 'F') lines_hit,
  CASE WHEN count(*) = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * count(*) FILTER (l_linestatus = 'F') / count(*) END pct FROM lineitem GROUP BY 1)"""
CUTOFF = 1_000_000_000_000


@query(f"WITH {CF}, {CHURN} SELECT * FROM churn")
def churn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.churn_files(tables.commit_files(spark, sf_dir), unique=True)


@query(f"WITH {CF} SELECT count(DISTINCT path) files, count(DISTINCT sha) commits, CAST(sum(added) AS BIGINT) added, CAST(sum(deleted) AS BIGINT) deleted FROM cf")
def churn_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.churn_totals(tables.commit_files(spark, sf_dir))


AS_OF = 883_612_800  # 1998-01-01


@query(f"WITH {CF} SELECT path, count(DISTINCT sha) commits, CAST(sum(added) AS BIGINT) added, CAST(sum(deleted) AS BIGINT) deleted FROM cf WHERE ts >= {AS_OF} - 90 * 86400 GROUP BY path")
def churn_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.churn_files(churn.window(tables.commit_files(spark, sf_dir), AS_OF, 90))


WS = ["s/1", "s/2", "s/10"]
WS_SQL = "CASE WHEN path = 's/10' OR starts_with(path, 's/10/') THEN 's/10' WHEN path = 's/2' OR starts_with(path, 's/2/') THEN 's/2' WHEN path = 's/1' OR starts_with(path, 's/1/') THEN 's/1' END"


@query(f"WITH {DENSE} SELECT workspace, count(DISTINCT path) files, count(DISTINCT sha) commits FROM (SELECT *, {WS_SQL} workspace FROM cf) GROUP BY workspace")
def churn_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = churn.assign_workspace(tables.commit_files(spark, sf_dir, dense=True), WS)
    return rows.groupBy("workspace").agg(F.count_distinct("path").alias("files"), F.count_distinct("sha").alias("commits"))


@query("SELECT * FROM (VALUES ('pkg/web/a.ts', 'pkg/web'), ('pkg/webs/a.ts', NULL), ('pkg/api', 'pkg/api'), ('pkg/api/x/y.go', 'pkg/api'), ('README.md', NULL)) t(path, workspace)")
def workspace_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in ("pkg/web/a.ts", "pkg/webs/a.ts", "pkg/api", "pkg/api/x/y.go", "README.md")], "path string")
    return churn.assign_workspace(rows, ["pkg/web", "pkg/api"])


PAIRS = """ok AS (SELECT sha FROM cf GROUP BY sha HAVING count(*) <= 50), x AS (SELECT sha, path FROM cf SEMI JOIN ok USING (sha)),
n AS (SELECT count(DISTINCT sha) n FROM x), fc AS (SELECT path, count(*) k FROM x GROUP BY path),
p AS (SELECT l.path a, r.path b, count(*) "count" FROM x l JOIN x r ON l.sha = r.sha AND string_split(l.path, '/') < string_split(r.path, '/') GROUP BY 1, 2),
c AS (SELECT p.a, p.b, p."count", fa.k count_a, fb.k count_b, p."count" * CAST(n.n AS DOUBLE) / (CAST(fa.k AS DOUBLE) * fb.k) lift,
  CASE WHEN p."count" / fa.k >= 0.5 AND p."count" / fb.k >= 0.5 THEN 'symmetric' WHEN p."count" / fb.k > p."count" / fa.k THEN 'from_a' ELSE 'from_b' END direction
  FROM p JOIN fc fa ON p.a = fa.path JOIN fc fb ON p.b = fb.path CROSS JOIN n)"""
SPARSE = Params(min_coupling=2)


def _coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.coupling(tables.commit_files(spark, sf_dir, by=("sha",)), SPARSE, unique=True)


@query(f"""WITH {CF}, {PAIRS} SELECT a, b, "count", count_a, count_b, round(lift, 6) lift, direction FROM c WHERE "count" >= 2 AND lift >= 2""")
def coupling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coupling(spark, sf_dir).select("a", "b", "count", "count_a", "count_b", rounded("lift"), "direction")


@query(f"""WITH {DENSE}, {PAIRS} SELECT a, b, "count", round(lift, 6) lift FROM c WHERE "count" >= 3 AND lift >= 1""")
def coupling_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.coupling(tables.commit_files(spark, sf_dir, dense=True, by=("sha",)), Params(min_coupling=3, min_lift=1.0), unique=True).select("a", "b", "count", rounded("lift"))


@query(f"""WITH {DENSE}, {PAIRS} SELECT direction, count(*) pairs FROM c WHERE "count" >= 1 GROUP BY direction""")
def coupling_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.coupling(tables.commit_files(spark, sf_dir, dense=True, by=("sha",)), Params(min_coupling=1, min_lift=0.0), unique=True).groupBy("direction").agg(F.count("*").alias("pairs"))


@query(f"""WITH {CF}, {PAIRS}, q AS (SELECT * FROM c WHERE "count" >= 2 AND lift >= 2)
SELECT path, CAST(sum("count") AS BIGINT) "sum" FROM (SELECT a path, "count" FROM q UNION ALL SELECT b, "count" FROM q) GROUP BY path""")
def coupling_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.sums(_coupling(spark, sf_dir))


@query(f"WITH {DENSE}, ok AS (SELECT sha FROM cf GROUP BY sha HAVING count(*) <= 4) SELECT path, count(*) n FROM cf SEMI JOIN ok USING (sha) GROUP BY path")
def coupling_bulk_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.capped(tables.commit_files(spark, sf_dir, dense=True, by=("sha",)), 4, unique=True).groupBy("path").agg(F.count("*").alias("n"))


ROLES = [
    ("Cargo.lock", "lockfile"), ("docs/package-lock.json", "lockfile"), ("go.sum", "lockfile"), ("web/dist/a.js", "generated"), ("a/b.min.css", "generated"), ("target/x.rs", "source"),
    ("src/a_test.go", "test"), ("tests/x.py", "test"), ("src/a.spec.ts", "test"), ("README.md", "doc"), ("docs/a.ts", "doc"), ("src/lib.rs", "source"), ("contest/a.py", "source"),
]


def values(rows: list[tuple], names: str) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


@query(values(ROLES, "path, role"))
def file_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p, _ in ROLES], "path string").select("path", paths.role(F.col("path")).alias("role"))


CLASSES = [
    ("Cargo.lock", "src/a.rs", "lockfile"), ("dist/a.js", "src/a.js", "generated"), ("src/mod.rs", "src/a.rs", "manifest"), ("src/mod.rs", "src/lib.rs", "genuine"),
    ("src/mod.rs", "lib/a.rs", "genuine"), ("src/a.rs", "tests/a.rs", "test_src"), ("docs/a.md", "src/a.rs", "doc_src"), ("src/a.rs", "src/b.rs", "genuine"),
]


@query(values(CLASSES, "a, b, class"))
def coupling_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([c[:2] for c in CLASSES], "a string, b string")
    return rows.select("a", "b", paths.pair_class(F.col("a"), F.col("b")).alias("class"))


HOT = f"WITH {CF}, {CHURN}, {FN}, cx AS (SELECT path, CAST(sum(ccn) AS BIGINT) ccn_sum FROM fn GROUP BY path), hs AS (SELECT path, commits, ccn_sum, CAST(ccn_sum * commits AS DOUBLE) score FROM churn JOIN cx USING (path) WHERE ccn_sum > 0)"


def _hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots.hotspot(churn_files(spark, sf_dir), tables.functions(spark, sf_dir))


@query(f"{HOT} SELECT * FROM hs")
def hotspot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hotspots(spark, sf_dir)


@query(f"{HOT} SELECT path, commits, ccn_sum, CAST(6 * ccn_sum * commits AS DOUBLE) score FROM hs")
def hotspot_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots.hotspot(churn_files(spark, sf_dir), tables.functions(spark, sf_dir), 2.0, 3.0)


@query(f"{HOT}, q AS (SELECT quantile_cont(score, 0.9) p90 FROM hs) SELECT path, score, score >= 22 AND score >= p90 hot FROM hs CROSS JOIN q")
def hotspot_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _hotspots(spark, sf_dir)
    cal = calibration.calibrate(scores.select(F.lit("").alias("cohort"), F.lit("hotspot").alias("metric"), F.col("score").alias("value")))
    return calibration.flag_hot(scores.select("path", "score"), cal)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = tables.functions(spark, sf_dir)
    one = lambda c, m: fn.select(c.alias("cohort"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), "path", "name")
    return one(F.lit(""), "ccn").union(one(F.lit(""), "cognitive"))


VALS = "v AS (SELECT '' cohort, 'ccn' metric, CAST(ccn AS DOUBLE) \"value\", path, \"name\" FROM fn UNION ALL SELECT '', 'cognitive', CAST(cognitive AS DOUBLE), path, \"name\" FROM fn)"
CAL = """cal AS (SELECT cohort, metric, count(*) n, quantile_cont("value", 0.5) p50, quantile_cont("value", 0.75) p75, quantile_cont("value", 0.9) p90, quantile_cont("value", 0.95) p95,
  CASE metric WHEN 'ccn' THEN 25.0::DOUBLE ELSE 50.0::DOUBLE END floor_critical, CASE metric WHEN 'ccn' THEN 11.0::DOUBLE ELSE 8.0::DOUBLE END floor_ok FROM v GROUP BY 1, 2)"""
BREAKS = ", ".join(f"round({c}, 6) {c}" for c in ("p50", "p75", "p90", "p95"))


def _breaks(df: DataFrame) -> DataFrame:
    return df.select("cohort", "metric", "n", *(rounded(c) for c in calibration.BREAKS), "floor_critical", "floor_ok")


@query(f"WITH {FN}, {VALS}, {CAL} SELECT cohort, metric, n, {BREAKS}, floor_critical, floor_ok FROM cal")
def calib_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaks(calibration.calibrate(_values(spark, sf_dir).select("cohort", "metric", "value")))


BY_COHORT = "v AS (SELECT cohort, 'ccn' metric, CAST(ccn AS DOUBLE) \"value\", path, \"name\" FROM fn)"


@query(f"WITH {FN}, {BY_COHORT}, {CAL} SELECT cohort, metric, n, {BREAKS}, floor_critical, floor_ok FROM cal")
def calib_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = tables.functions(spark, sf_dir)
    return _breaks(calibration.calibrate(fn.select("cohort", F.lit("ccn").alias("metric"), F.col("ccn").cast("double").alias("value"))))


SMALL = [("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", 4.0), ("b", 5.0)]


@query("SELECT * FROM (VALUES ('a', CAST(2 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), ('b', CAST(5 AS BIGINT), CAST(3 AS DOUBLE), CAST(4 AS DOUBLE))) t(cohort, n, p50, p75)")
def calib_small_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SMALL, "cohort string, value double").withColumn("metric", F.lit("lcom"))
    return calibration.calibrate(rows).select("cohort", "n", "p50", "p75")


CLASSIFIED = f"""WITH {FN}, {VALS}, {CAL}, s AS (SELECT path, "name", metric, "value", CASE WHEN "value" >= floor_critical THEN 'critical' WHEN "value" < floor_ok THEN 'ok'
  WHEN floor_critical > floor_ok AND p95 - p50 < (floor_critical - floor_ok) / 2 THEN 'ok' WHEN "value" >= p95 THEN 'critical' WHEN "value" >= p90 THEN 'high' WHEN "value" >= p75 THEN 'medium' ELSE 'ok' END severity
  FROM v JOIN cal USING (cohort, metric))"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir)
    return calibration.classified(v, calibration.calibrate(v.select("cohort", "metric", "value")))


@query(f"""{CLASSIFIED} SELECT path, "name", metric, "value", severity FROM s""")
def classify_ccn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("path", "name", "metric", "value", "severity")


GATE = [(10.0, "ok"), (14.0, "ok"), (30.0, "critical")]


@query("SELECT CAST(v AS DOUBLE) \"value\", s severity FROM (VALUES (10, 'ok'), (14, 'ok'), (30, 'critical')) t(v, s)")
def classify_spread_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("", "ccn", v) for v, _ in GATE], "cohort string, metric string, value double")
    cal = spark.createDataFrame([("", "ccn", 12.0, 13.0, 13.5, 14.0, 25.0, 11.0)], "cohort string, metric string, p50 double, p75 double, p90 double, p95 double, floor_critical double, floor_ok double")
    return calibration.classified(rows, cal).select("value", "severity")


@query(f"{CLASSIFIED} SELECT count(*) FILTER (severity = 'critical') critical, count(*) FILTER (severity = 'high') high, count(*) FILTER (severity = 'medium') medium, count(*) FILTER (severity = 'ok') ok FROM s")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.severity_counts(_classified(spark, sf_dir).withColumn("accepted", F.lit(False)))


@query(f"{CLASSIFIED}, w AS (SELECT *, CASE WHEN path = 'p/1' OR path = 'p/2' OR path = 'p/3' THEN path END workspace FROM s) SELECT workspace, count(*) FILTER (severity = 'critical') critical, count(*) FILTER (severity = 'high') high, count(*) FILTER (severity = 'medium') medium, count(*) FILTER (severity = 'ok') ok FROM w WHERE workspace IS NOT NULL GROUP BY workspace")
def severity_by_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.severity_counts(churn.assign_workspace(_classified(spark, sf_dir), ["p/1", "p/2", "p/3"]), "workspace")


TIERED = f"""{CLASSIFIED}, h AS (SELECT *, length("name") % 2 = 0 hot FROM s), t AS (SELECT *, CASE WHEN severity = 'ok' THEN NULL WHEN severity = 'critical' AND hot THEN 'must' WHEN severity = 'critical' OR (severity = 'high' AND hot) THEN 'should' ELSE 'advisory' END tier FROM h)"""


@query(f"{TIERED} SELECT metric, severity, hot, tier, count(*) n FROM t GROUP BY ALL")
def drain_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir).withColumn("hot", F.length("name") % 2 == 0)
    return rows.withColumn("tier", findings.tier(F.col("metric"), F.col("severity"), F.col("hot"))).groupBy("metric", "severity", "hot", "tier").agg(F.count("*").alias("n"))


@query(f"{TIERED} SELECT count(*) FILTER (tier = 'must') must, count(DISTINCT path) FILTER (tier = 'must') must_files, count(*) FILTER (tier = 'should') should, count(DISTINCT path) FILTER (tier = 'should') should_files FROM t")
def drain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    rows = rows.select("metric", "severity", (F.length("name") % 2 == 0).alias("hotspot"), F.struct(F.col("path").alias("file")).alias("location"), F.lit(False).alias("accepted"))
    return findings.drain_summary(rows)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.merge(tables.coverage(spark, sf_dir))


@query(f"WITH {COV} SELECT path, lines_found, lines_hit, round(pct, 6) pct FROM cov")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).select("path", "lines_found", "lines_hit", rounded("pct"))


@query("""WITH r AS (SELECT 'p/' || CAST(l_partkey AS VARCHAR) path, l_returnflag f, count(*) a, count(*) FILTER (l_linestatus = 'F') b FROM lineitem GROUP BY 1, 2)
SELECT path, max(a) lines_found, max(b) lines_hit, round(100.0::DOUBLE * max(b) / max(a), 6) pct FROM r GROUP BY path""")
def coverage_merge_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.table(spark, sf_dir, "lineitem")
    rows = line.groupBy(F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("path"), "l_returnflag").agg(F.count("*").alias("lines_found"), F.count_if(F.col("l_linestatus") == "F").alias("lines_hit"))
    return coverage.merge(rows.drop("l_returnflag")).select("path", "lines_found", "lines_hit", rounded("pct"))


@query(f"""WITH {COV}, v AS (SELECT path, 100 - pct "value" FROM cov), q AS (SELECT quantile_cont("value", 0.5) p50, quantile_cont("value", 0.75) p75, quantile_cont("value", 0.9) p90, quantile_cont("value", 0.95) p95 FROM v)
SELECT path, CASE WHEN "value" >= 95 THEN 'critical' WHEN "value" < 25 OR p95 - p50 < 35 THEN 'ok' WHEN "value" >= p95 THEN 'critical' WHEN "value" >= p90 THEN 'high' WHEN "value" >= p75 THEN 'medium' ELSE 'ok' END severity FROM v CROSS JOIN q""")
def coverage_inverted_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _coverage(spark, sf_dir).select(F.lit("").alias("cohort"), F.lit("coverage_pct").alias("metric"), (F.lit(100.0) - F.col("pct")).alias("value"), "path")
    return calibration.classified(v, calibration.calibrate(v.drop("path"))).select("path", "severity")


LCOV = "TN:\nSF:a.rs\nDA:1,1\nDA:2,0\nLF:3\nLH:2\nend_of_record\nSF:b.rs\nDA:1,0\nBRDA:1,0,0,-\nBRDA:1,0,1,4\nBRF:3\nBRH:1\nend_of_record\nSF:c.rs\nDA:1,1\nDA:2,1\nDA:9,x\nBRDA:1,0,0,-\nBRDA:1,0,1,4"


@query("SELECT p path, CAST(a AS BIGINT) lines_found, CAST(b AS BIGINT) lines_hit, CAST(c AS BIGINT) branches_found, CAST(d AS BIGINT) branches_hit FROM (VALUES ('a.rs', 3, 2, 0, 0), ('b.rs', 1, 0, 3, 1), ('c.rs', 3, 2, 2, 1)) t(p, a, b, c, d)")
def lcov_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.parse_lcov(spark.createDataFrame([("lcov.info", LCOV)], "source string, text string")).drop("source")


@query("""WITH t AS (SELECT 's/' || CAST(l_suppkey AS VARCHAR) path, count(*) total, count(*) FILTER (l_returnflag = 'R') skipped FROM lineitem GROUP BY 1) SELECT path, total, skipped, round(100.0::DOUBLE * skipped / total, 6) pct FROM t""")
def skip_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.skip_ratio(tables.tests(spark, sf_dir)).select("path", "total", "skipped", rounded("pct"))


@query("""WITH t AS (SELECT 's/' || CAST(l_suppkey AS VARCHAR) path, 100.0::DOUBLE * count(*) FILTER (l_returnflag = 'R') / count(*) v FROM lineitem GROUP BY 1), w AS (SELECT * FROM t WHERE v > 0),
q AS (SELECT quantile_cont(v, 0.5) p50, quantile_cont(v, 0.75) p75, quantile_cont(v, 0.9) p90, quantile_cont(v, 0.95) p95 FROM w)
SELECT path, CASE WHEN v >= 20 THEN 'critical' WHEN v < 0.5 OR p95 - p50 < 9.75 THEN 'ok' WHEN v >= p95 THEN 'critical' WHEN v >= p90 THEN 'high' WHEN v >= p75 THEN 'medium' ELSE 'ok' END severity FROM w CROSS JOIN q""")
def skip_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = coverage.skip_ratio(tables.tests(spark, sf_dir)).where("skipped > 0").select(F.lit("").alias("cohort"), F.lit("skip_ratio").alias("metric"), F.col("pct").alias("value"), "path")
    return calibration.classified(v, calibration.calibrate(v.drop("path"))).select("path", "severity")


TEST_HOT = f"WITH {CF}, {CHURN}, {COV} SELECT path, commits, round(coalesce(100 - pct, 100), 6) uncovered_pct, round(commits * coalesce(100 - pct, 100), 6) score FROM churn LEFT JOIN (SELECT * FROM cov WHERE lines_found > 20) USING (path) WHERE commits * coalesce(100 - pct, 100) > 0"


@query(TEST_HOT)
def test_hotspot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hotspots.test_hotspot(churn_files(spark, sf_dir), _coverage(spark, sf_dir).where("lines_found > 20"))
    return out.select("path", "commits", rounded("uncovered_pct"), rounded("score"))


FRESH = """ch AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'docs/' ELSE 'src/' END || CAST(o_custkey AS VARCHAR) path, CAST(o_orderkey AS VARCHAR) sha, CAST(epoch(o_orderdate) AS BIGINT) ts FROM orders),
last AS (SELECT path, max(ts) t FROM ch WHERE starts_with(path, 'docs/') GROUP BY path),
fr AS (SELECT 'docs/' || CAST(c_custkey AS VARCHAR) doc, any_value(t) doc_last, count(DISTINCT ch.ts) FILTER (ch.ts > t) since FROM customer LEFT JOIN last ON last.path = 'docs/' || CAST(c_custkey AS VARCHAR) LEFT JOIN ch ON ch.path = 'src/' || CAST(c_custkey AS VARCHAR) GROUP BY c_custkey)"""


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.freshness(tables.doc_pairs(spark, sf_dir), tables.histories(spark, sf_dir))


@query(f"WITH {FRESH} SELECT doc, since, doc_last FROM fr")
def doc_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir).drop("srcs")


@query(f"WITH {FRESH} SELECT doc, CASE WHEN since >= 20 THEN 'critical' WHEN since >= 5 THEN 'high' WHEN since >= 1 THEN 'medium' ELSE 'ok' END severity FROM fr")
def doc_freshness_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir).select("doc", docs.freshness_severity(F.col("since")).alias("severity"))


@query(f"""WITH {FRESH}, sc AS (SELECT path, count(DISTINCT sha) k FROM ch GROUP BY path), d AS (SELECT 'docs/' || CAST(c_custkey AS VARCHAR) doc, c_custkey % 3 g FROM customer WHERE c_custkey % 3 > 0)
SELECT doc, coalesce(k, 0) src_churn, CAST(since + coalesce(g, 0) AS DOUBLE) debt, CAST(coalesce(k, 0) * (since + coalesce(g, 0)) AS DOUBLE) score FROM fr LEFT JOIN sc ON sc.path = replace(doc, 'docs/', 'src/') LEFT JOIN d USING (doc) WHERE coalesce(k, 0) * (since + coalesce(g, 0)) > 0""")
def doc_hotspot(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = tables.histories(spark, sf_dir).withColumns({"added": F.lit(0), "deleted": F.lit(0)})
    gone = tables.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("docs/"), F.col("c_custkey").cast("string")).alias("doc"), (F.col("c_custkey") % 3).alias("dangling"))
    return hotspots.doc_hotspot(_fresh(spark, sf_dir), churn.churn_files(changes), gone)


@query("""SELECT 'src/' || CAST(c_custkey AS VARCHAR) src, 'docs/' || CAST(c_custkey AS VARCHAR) doc FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.missing_docs(tables.doc_pairs(spark, sf_dir), tables.histories(spark, sf_dir).select("path").distinct())


SITE = [
    ("README.md", "# Home page\nsee [other](docs/other.md \"Title\") and [gone](docs/gone.md) or [x](#home-page) and [y](#nowhere)\n```\n[no](no.md)\n```\n![img](pic.png) [ext](https://a.b/c) \\[esc](esc.md)\n"),
    ("docs/other.md", "back to [root](/README.md), `Alive` and `GoneForReal` and `a::b` and `cfg.toml` and ``x `y` z``\nTODO and `TODO` FIXME\n"),
    ("docs/lost.md", "TBD XXX\n~~~\nTODO\n~~~\n[self](./lost.md) `Alive::run` `deadbeef1`\n"),
    ("docs/alone.md", "Nothing leads here.\n"),
]


def _site(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITE, "path string, body string")


@query(values([("README.md", 2, "docs/gone.md", "missing_path"), ("README.md", 2, "#nowhere", "missing_anchor")], "path, line, target, kind").replace("SELECT *", "SELECT path, CAST(line AS BIGINT) line, target, kind"))
def link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = _site(spark)
    return docs.broken_links(docs.doc_links(site), site.select("path"), docs.headings(site))


@query(values([("docs/alone.md",)], "path"))
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = _site(spark)
    return docs.orphans(site, docs.doc_links(site), spark.createDataFrame([], "path string"))


RESOLVE = [("docs/sub/page.md", "./sibling.md", "docs/sub/sibling.md"), ("docs/sub/page.md", "../other.md", "docs/other.md"), ("docs/sub/page.md", "/CONTRIBUTING.md", "CONTRIBUTING.md"), ("a.md", "../../b.md", "b.md"), ("x/a.md", "y//./z.md", "x/y/z.md")]


@query(values(RESOLVE, "doc, target, resolved"))
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in RESOLVE], "doc string, target string")
    return rows.withColumn("resolved", paths.resolve(F.col("doc"), F.col("target")))


@query("""SELECT regexp_extract(split_part(h, '#', 1), '^([a-z]+:)?', 0) scheme, count(*) n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) h FROM pages) GROUP BY 1""")
def page_link_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_links(spark, sf_dir).groupBy(F.regexp_extract(F.substring_index("target", "#", 1), "^([a-z]+:)?", 0).alias("scheme")).agg(F.count("*").alias("n"))


LINES = "l AS (SELECT doc_id, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) t, generate_subscripts(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)), 1) line FROM documents WHERE text <> '')"


@query(f"WITH {LINES} SELECT 'd/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') path, CAST(line AS BIGINT) line, length(t) chars FROM l")
def prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = markup.prose_lines(tables.docs(spark, sf_dir))
    return out.select("path", "line", F.length("text").cast("long").alias("chars"))


def _count(m: str) -> str:
    return f"(length(text) - length(replace(text, '{m}', ''))) // {len(m)}"


@query(f"SELECT 'd/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') path, CAST({_count('The')} + {_count('Der')} AS BIGINT) markers FROM documents WHERE {_count('The')} + {_count('Der')} > 0")
def todo_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.todo_density(tables.docs(spark, sf_dir), ("The", "Der"), code_too=True)


@query(values([("docs/lost.md", 2), ("docs/other.md", 2)], "path, markers").replace("SELECT *", "SELECT path, CAST(markers AS BIGINT) markers"))
def todo_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.todo_density(_site(spark))


@query("SELECT lang, CAST(sum(CASE WHEN n >= 10 THEN 1 ELSE 0 END) AS BIGINT) high, CAST(sum(CASE WHEN n >= 3 AND n < 10 THEN 1 ELSE 0 END) AS BIGINT) medium FROM (SELECT lang, " + _count("The") + " n FROM documents) GROUP BY lang")
def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select("lang", docs.todo_severity(markup.marker_count(F.col("text"), ("The",))).alias("s"))
    return rows.groupBy("lang").agg(F.count_if(F.col("s") == "high").alias("high"), F.count_if(F.col("s") == "medium").alias("medium"))


SLUG_SQL = "regexp_replace(lower(regexp_replace(regexp_replace(p_name || ' -_ End!', '[^A-Za-z0-9\\s_-]', '', 'g'), '[\\s_-]+', '-', 'g')), '-+$', '')"


@query(f"SELECT p_partkey, {SLUG_SQL} slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select("p_partkey", markup.slug(F.concat("p_name", F.lit(" -_ End!"))).alias("slug"))


@query(values([("docs/other.md", 1, "GoneForReal"), ("docs/other.md", 2, "TODO")], "doc, line, name").replace("SELECT *", "SELECT doc, CAST(line AS BIGINT) line, name"))
def doc_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([("docs/other.md", ["src/a.rs"]), ("docs/lost.md", ["src/a.rs", "src/b.rs"])], "doc string, srcs array<string>")
    known = spark.createDataFrame([("src/a.rs", "Alive"), ("src/b.rs", "run")], "path string, name string")
    return docs.drift(pairs, docs.mentions(_site(spark)), known).drop("srcs")


WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{L}\\p{N}_]+')"
DUP_SIZE = 30


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.docs(spark, sf_dir).select("path", duplication.words_of(F.col("body")).alias("tokens"))


WINDOWS = f"""d AS (SELECT 'd/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') path, {WORDS} w FROM documents), n AS (SELECT path, w, unnest(generate_series(1, len(w) - {DUP_SIZE} + 1)) i FROM d WHERE len(w) >= {DUP_SIZE}),
x AS (SELECT path, hash(array_to_string(w[i:i + {DUP_SIZE} - 1], chr(1))) h FROM n), g AS (SELECT h, count(*) times, count(DISTINCT path) files, min(path) "first" FROM x GROUP BY h HAVING count(*) >= 2)"""


@query(f'WITH {WINDOWS} SELECT "first", times, files, count(*) windows FROM g GROUP BY ALL')
def dup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.shared_windows(_words(spark, sf_dir), DUP_SIZE).groupBy("first", "times", "files").agg(F.count("*").alias("windows"))


@query(f"WITH {WINDOWS} SELECT path, count(*) windows, count(*) FILTER (h IN (SELECT h FROM g)) shared FROM x GROUP BY path")
def dup_doc_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.shared_in_files(_words(spark, sf_dir), DUP_SIZE)


CODE = [("a.py", "x = 1\ndef f(a, b):\n    return a + b * 2 - 1\n"), ("b.py", "y = 2\ny = 3\ndef f(a, b):\n    return a + b * 2 - 1\nz = 9\n"), ("c.py", "q()\n")]


@query(values([("a.py", 16), ("b.py", 16)], "path, tokens").replace("SELECT *", "SELECT path, CAST(tokens AS BIGINT) tokens"))
def dup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..parsing import python_code

    rows = [(p, [t for t, _ in python_code.parse(s).tokens], [n for _, n in python_code.parse(s).tokens]) for p, s in CODE]
    return duplication.blocks(spark.createDataFrame(rows, "path string, tokens array<string>, lines array<long>"), 10).select("path", "tokens")


@query()
def lcom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the parts in them: all of them are one graph, too large for recursive SQL; tests hold
    it against brute force."""
    line = tables.table(spark, sf_dir, "lineitem")
    return graphs.components(line.select(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("b")), ready=True)


SNAP = """SELECT 'ccn:c/' || CAST(o_custkey AS VARCHAR) id, CAST(greatest(0, least(floor((count(*) + {shift}) / 4), 3)) AS INTEGER) r, count(*) % 2 = 0 hot, o_custkey % 7 = 0 acc FROM orders WHERE o_orderdate < TIMESTAMP '{until}' GROUP BY o_custkey"""
OLD, NEW = ("1997-01-01", 2), ("1998-06-01", -3)
DIFF = f"""WITH a AS ({SNAP.format(until=OLD[0], shift=OLD[1])}), b AS ({SNAP.format(until=NEW[0], shift=NEW[1])}),
d AS (SELECT id, a.r o, b.r n, a.hot h, a.acc acc, CASE WHEN b.r IS NULL THEN 'resolved' WHEN a.r IS NULL THEN 'new' WHEN b.r > a.r THEN 'regressed' WHEN b.r < a.r THEN 'improved' ELSE 'unchanged' END bucket FROM a FULL JOIN b USING (id))"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.snapshot(spark, sf_dir, *OLD), tables.snapshot(spark, sf_dir, *NEW)


@query(f"{DIFF} SELECT id, bucket FROM d")
def diff_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.diff(*_sides(spark, sf_dir)).select("id", "bucket")


@query(f"""{DIFF}, e AS (SELECT *, coalesce(o = 3 AND h AND NOT acc, false) t0 FROM d WHERE bucket <> 'new'), s AS (SELECT count(*) total, count(*) FILTER (bucket = 'resolved') resolved, count(*) FILTER (t0) t0_total, count(*) FILTER (t0 AND bucket = 'resolved') t0_resolved FROM e)
SELECT *, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE resolved / total END progress, CASE WHEN t0_total = 0 THEN 0.0::DOUBLE ELSE t0_resolved / t0_total END t0_progress FROM s""")
def diff_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.progress(state.diff(*_sides(spark, sf_dir)))


@query(f"{DIFF} SELECT id, bucket FROM d WHERE (o >= 2 OR n >= 2)")
def diff_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.visible(state.diff(*_sides(spark, sf_dir))).select("id", "bucket")


@query(f"WITH a AS ({SNAP.format(until=OLD[0], shift=0)}), b AS ({SNAP.format(until=NEW[0], shift=0)}) SELECT id finding_id, id IN (SELECT id FROM b) regressed FROM a WHERE acc")
def reconcile_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = tables.snapshot(spark, sf_dir, OLD[0]).where("accepted").select(F.col("id").alias("finding_id"))
    again, still = state.reconcile_fixed(fixed, tables.snapshot(spark, sf_dir, NEW[0]))
    return again.withColumn("regressed", F.lit(True)).union(still.withColumn("regressed", F.lit(False)))


@query(f"WITH b AS ({SNAP.format(until=NEW[0], shift=0)}) SELECT id, acc accepted FROM b")
def accepted_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = tables.snapshot(spark, sf_dir, NEW[0])
    return findings.accept(snap.withColumn("accepted", F.lit(False)), snap.where("accepted").select(F.col("id").alias("finding_id"))).select("id", "accepted")


@query(f"WITH a AS ({SNAP.format(until=OLD[0], shift=0)}), b AS ({SNAP.format(until=NEW[0], shift=0)}) SELECT b.id, a.r was_rank, b.r severity_rank FROM a JOIN b USING (id) WHERE b.r > a.r AND a.acc")
def accepted_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = tables.snapshot(spark, sf_dir, OLD[0]).where("accepted").select(F.col("id").alias("finding_id"), "severity_rank")
    return state.escalated(old, tables.snapshot(spark, sf_dir, NEW[0])).select("id", "was_rank", "severity_rank")


@query(f"{HOT} SELECT * FROM hs ORDER BY score DESC, string_split(path, '/') LIMIT 5")
def worst_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(_hotspots(spark, sf_dir), "hotspot", 5)


@query(f"WITH {CF}, {CHURN} SELECT * FROM churn ORDER BY commits DESC, string_split(path, '/') LIMIT 5")
def worst_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(churn_files(spark, sf_dir), "churn", 5)


@query(f"""WITH {CF}, {PAIRS} SELECT a, b, "count" FROM c WHERE "count" >= 2 AND lift >= 2 ORDER BY "count" DESC, string_split(a, '/'), string_split(b, '/') LIMIT 5""")
def worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(_coupling(spark, sf_dir), "pairs", 5).select("a", "b", "count")


@query(f"WITH {FN} SELECT path, \"name\", ccn FROM fn ORDER BY ccn DESC, string_split(path, '/'), \"name\" LIMIT 5")
def worst_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(tables.functions(spark, sf_dir), "ccn", 5).select("path", "name", "ccn")


@query(f"WITH {COV} SELECT path, round(pct, 6) pct FROM cov WHERE pct < 100 ORDER BY cov.pct, string_split(path, '/') LIMIT 5")
def worst_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst(_coverage(spark, sf_dir), "coverage", 5).select("path", rounded("pct"))


@query(f"""WITH {FN}, r AS (SELECT path, "name", ccn, row_number() OVER (PARTITION BY path, ccn ORDER BY "name") - 1 o FROM fn) SELECT path, "name", 'ccn:' || CAST(ccn AS VARCHAR) || CASE WHEN o = 0 THEN '' ELSE ':' || CAST(o AS VARCHAR) END seed FROM r""")
def ordinal_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.functions(spark, sf_dir)
    return findings.ordinals(rows, ["path", "ccn"], ["name"], F.concat(F.lit("ccn:"), F.col("ccn").cast("string"))).select("path", "name", "seed")


@query("""WITH x AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) run FROM x) SELECT user_id, CAST(run AS BIGINT) run, event_type, count(*) n FROM y GROUP BY ALL""")
def rle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.run_labels(tables.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


@query("SELECT CAST(line AS BIGINT) line, inside FROM (VALUES (1, false), (2, false), (3, true), (4, true), (5, false), (6, false), (7, true), (8, true), (9, false)) t(line, inside)")
def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ["alpha", "```", "bravo", "```", "charlie", "~~~", "delta", "~~~", "echo"]
    rows = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(text)], "doc string, line long, text string")
    return markup.fence_state(rows, "doc").select("line", "inside")


IDS = [("ccn", "src/foo.rs", "bar", "seed-1", "ccn:src/foo.rs:bar:f3be27acb1b52ed7"), ("hotspot", "src/hot.rs", None, "", "hotspot:src/hot.rs:*:b7d453c59f9c7d05")]


@query(values([(r[4],) for r in IDS], "id"))
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:4] for r in IDS], "metric string, file string, symbol string, seed string")
    from ..functions.hashing import finding_id

    return rows.select(finding_id(F.col("metric"), F.col("file"), F.col("symbol"), F.col("seed")).alias("id"))


SOURCES = [
    ("a.py", "python", "# note\nimport os\n\ndef f(a):\n    if a:\n        for x in a:\n            if x:\n                pass\n    return 1 if a else 2\n"),
    ("b.ts", "typescript", "/* head\n */\nfunction g(a, b) {\n  if (a && b) { return 1; }\n  for (const x of b) { h(x); }\n  return a ? 1 : 2;\n}\n"),
    ("t.rs", "rust", "#[test]\nfn a() {}\n#[test]\n#[ignore]\nfn b() {}\n#[test]\nfn c() {}\n"),
]


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "path string, language string, content string")


@query(values([("a.py", "f", 5, 7), ("b.ts", "g", 5, 4), ("t.rs", "a", 1, 0), ("t.rs", "b", 1, 0), ("t.rs", "c", 1, 0)], "path, name, ccn, cognitive").replace("SELECT *", "SELECT path, name, CAST(ccn AS BIGINT) ccn, CAST(cognitive AS BIGINT) cognitive"))
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import files

    return files.extracts(_sources(spark)).where("kind = 'function'").select("path", "name", "ccn", "cognitive")


@query("SELECT 't.rs' path, CAST(3 AS BIGINT) total_tests, CAST(1 AS BIGINT) skipped_tests")
def skip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import files

    return files.extracts(_sources(spark)).where("kind = 'tests'").select("path", "total_tests", "skipped_tests")


@query(values([("python", 1, 7, 1, 1), ("rust", 1, 7, 0, 0), ("typescript", 1, 5, 2, 0)], "language, files, code, comment, blank").replace("SELECT *", "SELECT language, CAST(files AS BIGINT) files, CAST(code AS BIGINT) code, CAST(comment AS BIGINT) comment, CAST(blank AS BIGINT) blank"))
def loc_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import files

    return files.by_language(files.line_counts(_sources(spark)))


@query(f"""{HOT}, q AS (SELECT quantile_cont(score, 0.9) p90 FROM hs), hp AS (SELECT path FROM hs CROSS JOIN q WHERE score >= 22 AND score >= p90), {CLASSIFIED.removeprefix(f"WITH {FN}, ")},
f AS (SELECT metric, path file, "name" symbol, severity, CASE metric WHEN 'ccn' THEN 'CCN=' ELSE 'Cognitive=' END || CAST("value" AS BIGINT) || ' ' || "name" || ' (sql)' summary FROM s WHERE "value" > 0
  UNION ALL SELECT 'hotspot', path, NULL, 'ok', 'hotspot score=' || CAST(score AS BIGINT) || ' (ccn_sum=' || ccn_sum || ', churn=' || commits || ')' FROM hs),
g AS (SELECT *, file IN (SELECT path FROM hp) hotspot FROM f)
SELECT *, CASE WHEN severity = 'ok' THEN NULL WHEN severity = 'critical' AND hotspot THEN 'must' WHEN severity = 'critical' OR (severity = 'high' AND hotspot) THEN 'should' ELSE 'advisory' END tier FROM g""")
def status_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of two reports, from their values to their tiers."""
    none = F.lit(None).cast("long")
    fn = tables.functions(spark, sf_dir).withColumns({"language": F.lit("sql"), "start_byte": F.lit(0), "start_line": none, "end_line": none}).drop("cohort")
    out = lowering.status({"functions": fn, "hotspot": _hotspots(spark, sf_dir)})
    return out.select("metric", F.col("location.file").alias("file"), F.col("location.symbol").alias("symbol"), "severity", "summary", "hotspot", "tier")


@query(f"{HOT}, q AS (SELECT quantile_cont(score, 0.9) p90 FROM hs) SELECT path, commits, ccn_sum, score, score >= 22 AND score >= p90 hot FROM hs CROSS JOIN q ORDER BY score DESC, string_split(path, '/') LIMIT 20")
def status_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the code base's hottest files against its own distribution."""
    scores = _hotspots(spark, sf_dir)
    cal = calibration.calibrate(scores.select(F.lit("").alias("cohort"), F.lit("hotspot").alias("metric"), F.col("score").alias("value")))
    return ranking.worst(calibration.flag_hot(scores, cal), "hotspot", 20)


from . import reports  # noqa: E402, F401 - the further queries add themselves to the two tables above
