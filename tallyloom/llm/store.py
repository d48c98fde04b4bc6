"""Tables written in the cluster's shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local session (tests) gets a temporary one and any other is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of texts that a worker is sent at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Has workers sent BATCH_ROWS rows at most at once: of texts, Spark's own number makes batches of a hundred megabytes and more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe when executors go.

    release: then lets go of finished shuffles.
    """
    spark, schema, path = df.sparkSession, df.schema, new_path(df.sparkSession, name)
    df.write.parquet(path)
    if release:
        del df
        released(spark)
    return spark.read.schema(schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage, upon which Spark deletes the shuffle files of jobs that nothing refers to any more."""
    for _ in range(2):  # what the first round lets go of, the second one finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Files of a clustered table, at most.
MOST_FILES = 20_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clustered(df: DataFrame, column: str, files: int, name: str) -> DataFrame:
    """df written once, dealt to files by the hash of a column: joins and groups by it read whole files and do not shuffle df again."""
    spark, table = df.sparkSession, f"tallyloom_{name}_{uuid.uuid4().hex}"
    df.repartition(files, column).write.option("path", new_path(spark, name)).option("compression", "zstd").bucketBy(files, column).saveAsTable(table)
    del df
    released(spark)
    return spark.table(table)


#: Rows of ids that are broadcast; more are shuffled.
FEW = 200_000


def few(ids: DataFrame, most: int = FEW) -> bool:
    """Whether so small a table may be broadcast; ids should be written, as it is counted."""
    return ids.limit(most + 1).count() <= most


def without(df: DataFrame, ids: DataFrame, column: str, most: int = FEW) -> DataFrame:
    """df less the rows whose column is among ids; nulls stay.  Few ids are broadcast, so that df is not shuffled."""
    ids = written(ids.select(column).distinct(), "ids")
    return df.join(F.broadcast(ids) if few(ids, most) else ids, column, "left_anti")


def bucketed(df: DataFrame, column: str, files: int, name: str) -> DataFrame:
    """df written where it is, each task dealing its rows to files by the hash of a column: unlike clustered, df is not shuffled at all, and a join by the column reads it as it lies."""
    spark, table = df.sparkSession, f"tallyloom_{name}_{uuid.uuid4().hex}"
    df.write.option("path", new_path(spark, name)).option("compression", "zstd").bucketBy(files, column).saveAsTable(table)
    return spark.table(table)
