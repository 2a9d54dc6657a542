"""Where operators keep intermediate tables: the folder the cluster names, shared by all machines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from insight.session import checkpoint_dir

#: Spark removes the shuffle files of a query that has ended.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, the folder that ``checkpoint_dir`` sets or refuses."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else checkpoint_dir(spark)


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: its lineage is cut, and a lost
    executor costs only the tasks that ran there.  ``free``: shuffle files of the writing go when it is done,
    not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = stage_folder(spark, name)
    before = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)
