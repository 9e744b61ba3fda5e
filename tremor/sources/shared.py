"""The folder that driver and executors share: tables that cut lineage, places for streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_place(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet under spark.checkpoint.dir, or under the warehouse where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{root or spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/_shared'}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: lineage ends there, and lost executors lose nothing."""
    at = new_place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
