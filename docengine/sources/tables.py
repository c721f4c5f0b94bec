"""Rows of a table that is small for the cluster, dealt over all its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASK_BYTES = 32 << 20  # what one task may well work through alone


def spread(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """df over as many tasks as the cluster has cores, if it is stored in less than task_bytes for each of them.

    A file of one row group is one task whatever its size, so text work on a small table would use a single core. What is
    shuffled for it is bounded by cores times task_bytes; a larger table has tasks enough and stays as it is scanned.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < cores * task_bytes else df
