"""Changing cubes: axes added and removed, cells filled, merged and compared. All are joins; nothing is changed in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


def add_axis(cells: DataFrame, leaves: DataFrame, column: str) -> DataFrame:
    """Every cell once for each leaf of the new axis; ``leaves(record_id)`` are a dimension's, so the product is the new cube."""
    return cells.crossJoin(leaves.select(F.col("record_id").alias(column)))


def remove_axis(cells: DataFrame, axes: list[str], drop: str, value: str = "value_str") -> DataFrame:
    """Cells without one axis; of those that meet the longest value that isn't zero stays, ties by value, then member."""
    left = [a for a in axes if a != drop]
    zero = F.coalesce(F.col(value), F.lit("")).isin("", "0")
    order = Window.partitionBy(*left).orderBy(zero, F.desc(F.length(F.coalesce(F.col(value), F.lit("")))), F.col(value), F.col(drop))
    return cells.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", drop)


def combinations(members: dict[str, DataFrame]) -> DataFrame:
    """All combinations of members of the axes; each frame has one column ``record_id``."""
    return reduce(DataFrame.crossJoin, [m.select(F.col("record_id").alias(a)) for a, m in members.items()])


def fill(cells: DataFrame, members: dict[str, DataFrame], value: Column, axes: list[str]) -> DataFrame:
    """Sets manual and missing cells of all leaf combinations to ``value``; formula cells stay."""
    grid = combinations(members).withColumn("_new", value)
    both = cells.join(grid, axes, "full")
    free = F.col("_new").isNotNull() & F.coalesce(F.col("rule") == "manual", F.lit(True))
    return both.withColumns({"value": F.when(free, F.col("_new")).otherwise(F.col("value")), "rule": F.coalesce("rule", F.lit("manual"))}).drop("_new")


def random_integers(low: int, high: int, seed: int, *keys: str) -> Column:
    """Integers in [low, high] that depend on the seed and the keys alone, so that a repeated task gives the same."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(high - low + 1)) + low).cast("double")


def fill_range(cells: DataFrame, along: list[str], order: str) -> DataFrame:
    """Copies the first value of each run of selected cells to its other manual cells."""
    w = Window.partitionBy(*along).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("value", F.when(F.col("rule") == "manual", F.first("value").over(w)).otherwise(F.col("value")))


def upsert(cells: DataFrame, new: DataFrame, keys: list[str], guard_manual: bool = True) -> DataFrame:
    """``new(keys, value)`` merged into ``cells(keys, value, rule)``; new and changed cells get rule formula, manual ones are kept if guarded."""
    both = cells.join(new.select(*keys, F.col("value").alias("_v")), keys, "full")
    take = F.col("_v").isNotNull()
    if guard_manual:
        take &= F.coalesce(F.col("rule") != "manual", F.lit(True))
    return both.withColumns({"value": F.when(take, F.col("_v")).otherwise(F.col("value")), "rule": F.when(take, "formula").otherwise(F.col("rule"))}).drop("_v")


def changed_cells(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, old_value, new_value)`` of cells that are new or differ by more than 1e-6."""
    both = new.select(*keys, F.col("value").alias("new_value")).join(old.select(*keys, F.col("value").alias("old_value")), keys, "left")
    return both.where(numbers.changed(F.col("old_value"), F.col("new_value"), F.col("old_value").isNull())).select(*keys, "old_value", "new_value")


def insert_missing(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows whose keys aren't there are added, the others ignored."""
    return rows.unionByName(new.dropDuplicates(keys).join(rows, keys, "left_anti").select(*rows.columns))


def reordered(items: DataFrame, ids: list[str], key: str) -> DataFrame:
    """sort_order by the place in an explicit list; items that aren't listed follow in their old order."""
    given = items.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{key} string, _p int")
    order = Window.orderBy(F.col("_p").asc_nulls_last(), "sort_order", key)
    return items.join(F.broadcast(given), key, "left").withColumn("sort_order", F.row_number().over(order) - 1).drop("_p")


def main_axis(axes: DataFrame, sheet_id: str, analytic_id: str) -> DataFrame:
    """One main axis for the sheet; a period axis cannot be it."""
    here = F.col("sheet_id") == sheet_id
    return axes.withColumn("is_main", F.when(here, (F.col("analytic_id") == analytic_id) & ~F.col("is_period")).otherwise(F.col("is_main")))


def with_default_main(axes: DataFrame) -> DataFrame:
    """Sheets without a main axis get their first axis that holds no periods."""
    w = Window.partitionBy("sheet_id")
    first = F.min(F.when(~F.col("is_period"), F.col("axis_idx"))).over(w)
    return axes.withColumn("is_main", F.when(F.max("is_main").over(w), F.col("is_main")).otherwise(F.coalesce(F.col("axis_idx") == first, F.lit(False))))


def without_model(tables: dict[str, DataFrame], model_id: str) -> dict[str, DataFrame]:
    """All tables that carry a model_id without one model's rows."""
    return {k: t.where(~F.col("model_id").eqNullSafe(F.lit(model_id))) if "model_id" in t.columns else t for k, t in tables.items()}


def without_range(cells: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Cells after the selected ones were deleted; formulas stay."""
    hit = selected.select(*keys).distinct().withColumn("_s", F.lit(True))
    return cells.join(hit, keys, "left").where(F.col("_s").isNull() | (F.col("rule") != "manual")).drop("_s")


def expected_but_missing(expected: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Of what was expected, say sheets of a workbook, what isn't there."""
    return expected.select(key).distinct().join(made.select(key), key, "left_anti")


def records_replaced(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records with those of the same id replaced and others added."""
    return records.join(new.select("record_id"), "record_id", "left_anti").unionByName(new.select(*records.columns))
