"""Whole operations: generate and write back, save with a log and recalculate, undo and recalculate, keep a calculation between sessions."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialized
from . import calc, editing, history
from .calc import KEY, Calculated, Model


def version_of(model: Model) -> str:
    """A number that changes with the structure of a model (axes, records, rules) and with its cells: which there are, their values, rules and formulas."""
    parts = (model.axes, model.records, model.rules.withColumn("scope", F.to_json("scope")), model.cells.select(*KEY, "value_str", "rule", "formula"))
    # As JSON nulls count too: a text that moves to another column is a change.
    sums = [df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")).alias("s")).first() for df in parts]
    return "-".join(f"{r.n}.{r.s or 0}" for r in sums)


def keep(result: Calculated, path: str, version: str) -> None:
    """Stores a calculation as Parquet below ``path``, under the version of its model."""
    for f in fields(Calculated):
        getattr(result, f.name).write.mode("overwrite").parquet(f"{path}/{version}/{f.name}")


def kept(spark: SparkSession, path: str, version: str) -> Calculated | None:
    """The stored calculation of a version; nothing if there is none, as after a change of the model or its cells."""
    from pyspark.errors import AnalysisException

    try:
        return Calculated(**{f.name: spark.read.parquet(f"{path}/{version}/{f.name}") for f in fields(Calculated)})
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def calculation(model: Model, path: str) -> Calculated:
    """The stored calculation if the model and its cells are as they were, else a new one, which is stored."""
    version, spark = version_of(model), model.cells.sparkSession
    if found := kept(spark, path, version):
        return found
    keep(calc.calculate(model), path, version)
    return kept(spark, path, version)


def written_back(cells: DataFrame, result: Calculated) -> DataFrame:
    """``cells`` with the values that a calculation changed; manual cells stay."""
    new = calc.changes(result).withColumnRenamed("value_str", "value")
    merged = editing.upsert(cells.select(*KEY, F.col("value_str").alias("value"), "rule"), new, KEY)
    texts = cells.select(*KEY, "formula")
    return merged.join(texts, KEY, "left").select(*KEY, F.col("value").alias("value_str"), "rule", "formula")


def generate(model: Model) -> tuple[DataFrame, Calculated]:
    """Full calculation: the cells after write-back, and the calculation."""
    result = calc.calculate(model)
    return materialized(written_back(model.cells, result), "cells"), result


def _numbers(edits: DataFrame) -> DataFrame:
    from ..functions import numbers

    return edits.select(*KEY, numbers.parsed_or_zero(F.col("value_str")).alias("value"))


def save(cells: DataFrame, result: Calculated | None, edits: DataFrame, next_seq: int) -> tuple[DataFrame, DataFrame, Calculated | None]:
    """Saves ``edits(sheet_id, coord, value_str, user_id, ts)``: cells, the new history rows and the calculation after them.

    Only edits that change a value are logged and evaluated. Without a calculation formulas wait for the next full one.
    """
    done, log = history.saved(cells, edits, KEY, next_seq)
    log = materialized(log, "log")
    done = done.join(cells.select(*KEY, "formula"), KEY, "left").join(log.select(*KEY, F.lit(True).alias("_e")), KEY, "left")
    done = done.withColumn("formula", F.when(F.col("_e"), F.lit(None).cast("string")).otherwise(F.col("formula"))).drop("_e")
    if result is None:
        return materialized(done, "cells"), log, None
    after = calc.update(result, _numbers(log.withColumnRenamed("new_value", "value_str")))
    return materialized(written_back(done, after), "cells"), log, after


def undo(cells: DataFrame, result: Calculated | None, log: DataFrame, seq: int) -> tuple[DataFrame, DataFrame, Calculated | None]:
    """Goes back to before entry ``seq``: cells, the history that is left and the calculation after that."""
    back, left = history.undone(log, seq, KEY)
    back = materialized(back, "back")
    put = cells.join(back.select(*KEY, F.struct("value_str").alias("_b")), KEY, "left")
    put = put.withColumn("value_str", F.when(F.col("_b").isNotNull(), F.col("_b.value_str")).otherwise(F.col("value_str"))).drop("_b")
    if result is None:
        return put, left, None
    after = calc.update(result, _numbers(back))
    return materialized(written_back(put, after), "cells"), left, after
