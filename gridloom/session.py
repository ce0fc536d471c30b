"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it has none and runs in one process (tests) is a temporary folder made and set."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialized(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder, partitioned by a column if asked for, and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
