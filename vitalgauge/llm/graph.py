"""Connected components of a graph whose edges stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept


def components(edges: DataFrame, into: Scratch | None = None) -> DataFrame:
    """node, label: the smallest node reachable over the edges (a, b), for each node of an edge.

    Each round takes the smallest label among a node's neighbours and then the label of
    its label, until none changes; the rounds grow with the logarithm of the longest
    path.  A node with many edges is joined between two written tables, so that its
    rows may be split over tasks, and minima are taken before the shuffle.  Tables of
    earlier rounds are removed; the result is a table of ``into``, or one that stays.

    Defined cases: an edge with a null end, or from a node to itself, is no edge, so a node
    with no other has no row; repeated edges count once; without edges there are no rows;
    other columns are not looked at.
    """
    if into is None:
        with Scratch(edges.sparkSession, "components") as s:
            return kept(components(edges, s), "components")
    s = into
    edges = s.kept(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"), "edges")
    first = edges.union(edges.select("b", "a")).toDF("node", "other").groupBy("node").agg(F.min("other").alias("label"))
    labels = s.kept(first.select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = [edges.join(labels, edges[x] == labels["node"]).select(F.col(y).alias("node"), "label", F.lit(None).cast("long").alias("was")) for x, y in (("a", "b"), ("b", "a"))]
        least = near[0].union(near[1]).union(labels.select("node", "label", F.col("label").alias("was"))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        least = s.kept(least, "least")
        s.drop(labels)
        if least.where("label <> was").isEmpty():
            return least.select("node", "label")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = s.kept(least.join(jump, "label").select("node", F.least("label", "far").alias("label")), "labels")
        s.drop(least)
