"""Tables computed once and written in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local session gets a temporary one and any other is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def kept(df: DataFrame, *by: str) -> DataFrame:
    """df computed now, once, and read as Parquet from the shared folder from then on, with the columns and rows that are asked for; by: columns of which each value has its own folder."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark).rstrip('/')}/tallyloom/kept-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)
