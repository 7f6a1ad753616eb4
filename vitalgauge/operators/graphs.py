"""Connected components by smallest labels, over any sortable node."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread import spread


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.  A session without one
    gets a temporary folder only where all of Spark is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="vitalgauge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends, and no executor's loss loses it."""
    path = path or f"{shared_folder(df.sparkSession)}/vitalgauge/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges that one task solves at once; what a task holds follows this and not the input.
BATCH = 1_000_000


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a[i], b[i]) and for each the smallest node that it is connected to.

    The larger of two roots is hung below its smallest neighbour, then all paths are cut short, so
    two rounds halve the roots of a component at least.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x := x[(apart := x != y)]):
        y = y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
        x, y = label[x], label[y]
    return nodes, nodes[label]


def thinned(edges: DataFrame, whole: bool = False) -> DataFrame:
    """Edges (u, v) of long ids that connect the same nodes: in each batch a node and its smallest one.
    ``whole``: all edges, which are few, in one batch, with a row (u, u) for the smallest ones."""

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, n = [], 0

        def solve() -> pa.RecordBatch:
            u, v = least_of(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            keep = slice(None) if whole else u != v
            return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH and not whole:
                yield solve()
                held, n = [], 0
        if n:
            yield solve()

    return (edges.coalesce(1) if whole else edges).mapInArrow(stars, "u long, v long")


def components(edges: DataFrame, ready: bool = False) -> DataFrame:
    """node, label: the smallest node reachable, for every node of (a, b); a node may be alone.  A
    null is no node.  The edges are read twice, so they are written first unless they are ``ready``.

    Nodes are numbered by their hashes (one by one if two have the same), so their order is random.
    Each task first thins its edges to stars.  In a round every node becomes the smallest of its
    neighbours and itself, and edges are drawn anew between what is left, so tables shrink from
    round to round; the last edges are solved by one task.  Then the rounds are read backwards.
    """
    spark, base = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/vitalgauge/graph-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path

    def drop(*names: str) -> None:
        for n in names:
            at = folder(f"{base}/{n}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    edges = edges.select("a", "b") if ready else written(edges.select("a", "b"), f"{base}/edges")
    keyed = edges.select("a", "b", F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))
    ends = F.array(F.struct(F.col("u").alias("id"), F.col("a").alias("node")), F.struct(F.col("v").alias("id"), F.col("b").alias("node")))
    names = written(keyed.select(F.explode(ends).alias("e")).select("e.id", "e.node").where("node is not null").distinct(), f"{base}/names")
    if not names.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        names = written(names.select(F.monotonically_increasing_id().alias("id"), "node"), f"{base}/numbered")
        one = lambda e, n: names.select(F.col("id").alias(n), F.col("node").alias(e))
        keyed = edges.join(one("a", "u"), "a").join(one("b", "v"), "b")
    links, tables = written(thinned(keyed.where("a is not null and b is not null and u <> v").select("u", "v")), f"{base}/links0"), []
    while links.count() > BATCH:
        both = links.union(links.select("v", "u"))
        up = written(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), f"{base}/up{len(tables)}")
        tables.append(up)
        for end in ("u", "v"):
            links = links.join(up.toDF(end, f"p{end}"), end)
        links = written(thinned(links.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))), f"{base}/links{len(tables)}")
        drop(f"links{len(tables) - 1}")
    roots = thinned(links, whole=True).toDF("u", "root")
    for up in reversed(tables):
        roots = up.join(roots.withColumnRenamed("u", "p"), "p", "left").select("u", F.coalesce("root", "p").alias("root"))
    of = written(names.join(roots.withColumnRenamed("u", "id"), "id", "left").select("node", F.coalesce("root", "id").alias("root")), f"{base}/roots")
    drop("edges", "names", "numbered", f"links{len(tables)}", *(f"up{n}" for n in range(len(tables))))
    out = written(of.join(of.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label"), f"{base}/labels")
    drop("roots")
    return out


def cohesion(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, clusters, methods: how many groups of methods a class falls into.

    methods: scope, method; edges: scope, a, b (two methods that touch the same field or call
    one another).
    """
    loops = methods.select("scope", F.col("method").alias("a"), F.col("method").alias("b"))
    return clusters(loops.union(edges.select("scope", "a", "b")))


def clusters(links: DataFrame) -> DataFrame:
    """:func:`cohesion` of links: scope, a, b; a method that touches nothing is linked to itself.

    No link leaves its class, so classes are dealt out once and solved where they are, many at
    a time.  A class is held by one task, as a number for each of its methods and links.
    """
    kind = dict(links.dtypes)["scope"]

    def solve(rows: pa.Table) -> pa.RecordBatch:
        coded = lambda *columns: pc.dictionary_encode(pa.concat_arrays([x for c in columns for x in rows.column(c).chunks]), null_encoding="encode")
        scope, ends = coded("scope"), coded("a", "b")
        first, n = scope.indices.to_numpy().astype(np.int64) * len(ends.dictionary), len(rows)
        nodes, least = least_of(*(first + side for side in np.split(ends.indices.to_numpy(), [n])))
        count = lambda x: pa.array(np.bincount(x // len(ends.dictionary), minlength=len(scope.dictionary)))
        return pa.RecordBatch.from_arrays([scope.dictionary, count(np.unique(least)), count(nodes)], ["scope", "clusters", "methods"])

    def classes(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, n, enough = [], 0, BATCH
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= enough:  # all classes but the last one are whole
                rows = pa.Table.from_batches(held)
                last = rows.column("scope")[n - 1]
                same = pc.equal(rows.column("scope"), last) if last.is_valid else pc.is_null(rows.column("scope"))
                if whole := n - pc.sum(same).as_py():
                    yield solve(rows.slice(0, whole))
                held, n = rows.slice(whole).to_batches(), n - whole
                enough = max(BATCH, 2 * n)
        if n:
            yield solve(pa.Table.from_batches(held))

    rows = spread(links, "scope").sortWithinPartitions("scope")
    return rows.mapInArrow(classes, f"scope {kind}, clusters long, methods long")
