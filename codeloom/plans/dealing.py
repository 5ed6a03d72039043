"""Numbers of tasks that follow the rows, so that a task's share, and its memory, does not grow with the input."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def tasks_for(spark: SparkSession, rows: int, in_a_task: int) -> int:
    """At least the session's number of partitions; AQE leaves a number that is given alone."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / in_a_task))


def dealt(rows: DataFrame, n: int, in_a_task: int, *keys: str) -> DataFrame:
    """The rows by their keys, in tasks for ``n`` rows."""
    return rows.repartition(tasks_for(rows.sparkSession, n, in_a_task), *keys)
