"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where that is unset (tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (own or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: its lineage ends, and a lost executor costs no rerun of what came before."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Drop all stored tables of this application, once no result needs them any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
