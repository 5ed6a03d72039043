"""The folder for intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir``; where that is unset, a folder of our own, but on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='codeloom-')}")
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get()
    return f"{where.rstrip('/')}/codeloom-graph"


def keep(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage."""
    where = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)
