"""The worst of a report.  An order and a limit, which Spark plans as one top-k by task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: report -> order columns: "-" is descending, "/" compares as a path
ORDERS = {
    "ccn": ("-ccn", "/path", "name"), "cognitive": ("-cognitive", "/path", "name"), "churn": ("-commits", "/path"),
    "pairs": ("-count", "/a", "/b"), "sums": ("-sum", "/path"), "hotspot": ("-score", "/path"), "doc_hotspot": ("-score", "/doc"),
    "test_hotspot": ("-score", "/path"), "lcom": ("-clusters", "/path", "name"), "loc": ("-code", "language"), "freshness": ("-since", "/doc"),
    "drift": ("/doc", "line", "name"), "links": ("/path", "line", "target"), "missing_docs": ("/src",), "orphans": ("/path",), "todo": ("-markers", "/path"),
    "coverage": ("pct", "/path"), "skip_ratio": ("-pct", "/path"), "duplication": ("-tokens", "/path", "start_line"),
}


def worst(report: DataFrame, kind: str, n: int) -> DataFrame:
    if kind == "coverage":
        report = report.where("pct < 100")
    if kind == "skip_ratio":
        report = report.where("skipped > 0")
    order = []
    for c in ORDERS[kind]:
        name = c.lstrip("-/")
        order.append(paths.key(F.col(name)) if c[0] == "/" else F.desc(name) if c[0] == "-" else F.asc(name))
    return report.orderBy(*order).limit(n)
