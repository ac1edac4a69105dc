"""The shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file:///tmp/checkpoints" if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
