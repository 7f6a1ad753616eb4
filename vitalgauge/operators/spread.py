"""How many tasks a shuffle is dealt out to."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of the largest table read, in its files, for each task.
TASK_BYTES = 8 << 20


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows with equal ``by`` in one task, in as many tasks as the input asks for, so that what a task
    holds doesn't grow with it; never in fewer than the session's."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = max((s // TASK_BYTES for s in sizes if s < 1 << 50), default=0)  # a frame whose size is not known has the largest number
    return rows.repartition(n, *by) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*by)
