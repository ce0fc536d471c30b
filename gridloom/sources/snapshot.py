"""A model as a folder of Parquet tables, and coordinate keys of other systems."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calc import Model


def save(model: Model, path: str) -> None:
    """Cells are partitioned by sheet, so that reading one sheet prunes the others."""
    for f in fields(Model):
        out = getattr(model, f.name).write.mode("overwrite")
        (out.partitionBy("sheet_id") if f.name == "cells" else out).parquet(f"{path}/{f.name}")


def load(spark: SparkSession, path: str) -> Model:
    return Model(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Model)})


def packed(coord: Column) -> Column:
    """Coordinates as ``1|2|3``."""
    return F.array_join(F.transform(coord, lambda x: x.cast("string")), "|")


def unpacked(key: Column) -> Column:
    return F.transform(F.split(key, r"\|"), lambda x: x.try_cast("long"))


def with_ids(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """Coordinates of foreign ids, ``coord_key`` as ``uuid|uuid``, as record ids; unknown ones are -1. ``ids(uuid, record_id)``."""
    parts = cells.select("coord_key", F.posexplode(F.split("coord_key", r"\|")).alias("i", "uuid")).distinct()
    known = parts.join(ids, "uuid", "left").groupBy("coord_key").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("record_id", F.lit(-1).cast("long")).alias("r")))).alias("x"))
    return cells.join(known.select("coord_key", F.transform("x", lambda e: e["r"]).alias("coord")), "coord_key")


def to_database(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Appends rows to a table of a database that Spark reaches by JDBC."""
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()
