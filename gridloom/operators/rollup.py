"""Set-based consolidation: closures joined to facts, one aggregation for all nodes of all axes.

This is the path for cubes without values or formulas of their own at inner nodes; ``calc`` serves the others. Facts are
summed to leaves before the closures multiply them, and partial sums run map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roll_up(facts: DataFrame, axes: dict[str, DataFrame], measures: list[str]) -> DataFrame:
    """Sums of ``measures`` for every combination of nodes; ``axes`` gives the closure ``(desc, anc)`` of each key column."""
    leaf = facts.groupBy(*axes).agg(*[F.sum(m).alias(m) for m in measures])
    for column, tree in axes.items():
        up = tree.select(F.col("desc").alias(column), F.col("anc").alias(f"_{column}"))
        leaf = leaf.join(up, column).drop(column).withColumnRenamed(f"_{column}", column)
    return leaf.groupBy(*axes).agg(*[F.sum(m).alias(m) for m in measures])


def ratio(numerator: str, denominator: str) -> Column:
    """Ratio of sums: null where the denominator is 0 or missing."""
    return F.try_divide(F.coalesce(F.col(numerator), F.lit(0.0)), F.coalesce(F.col(denominator), F.lit(0.0)))


def over_children(values: DataFrame, children: DataFrame, how: str, key: str = "record_id") -> DataFrame:
    """``(parent_id, value)``: SUM, AVERAGE or LAST over the direct ``children(record_id, parent_id, sort_order)``.

    Absent children count 0 in SUM and AVERAGE; LAST is the value of the last child in order, 0 if it is absent.
    """
    rows = children.where("parent_id is not null").join(values.select(F.col(key).alias("record_id"), F.coalesce("value", F.lit(0.0)).alias("value")), "record_id", "left")
    x = F.coalesce("value", F.lit(0.0))
    value = {"SUM": F.sum(x), "AVERAGE": F.avg(x), "LAST": F.max_by(x, F.struct("sort_order", "record_id"))}[how]
    return rows.groupBy("parent_id").agg(value.alias("value"))


def cube(facts: DataFrame, axes: list[str], measures: list[str]) -> DataFrame:
    """Sums over all subsets of ``axes``; a node for "all" is null, its bit in ``level`` set."""
    return facts.cube(*axes).agg(F.grouping_id().cast("long").alias("level"), *[F.sum(m).alias(m) for m in measures])


def shift(series: DataFrame, by: list[str], order: str, n: int, value: str = "value") -> Column:
    """``value`` of the period ``n`` places ahead (before, if negative) within ``by``."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.lead(value, n).over(w) if n >= 0 else F.lag(value, -n).over(w)


def running_balance(by: list[str], order: str, opening: Column, change: Column) -> Column:
    """``closing = closing(previous) + change`` as one window sum; ``opening`` is read from the first row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.first(opening).over(w) + F.sum(F.coalesce(change, F.lit(0.0))).over(w)


def group_check(values: DataFrame, tree: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether each parent's own value equals the sum of its children in every column, within a relative ``tolerance``.

    ``values(record_id, col, value)``, ``tree(record_id, parent_id)``; returns ``(parent_id, columns, matched, ok)``.
    """
    parts = values.join(tree, "record_id").groupBy("parent_id", "col").agg(F.sum("value").alias("parts"))
    own = values.select(F.col("record_id").alias("parent_id"), "col", F.col("value").alias("own"))
    ok = F.abs(F.col("own") - F.col("parts")) <= tolerance * F.greatest(F.abs("own"), F.lit(1e-9))
    return own.join(parts, ["parent_id", "col"]).groupBy("parent_id").agg(
        F.count("*").alias("columns"), F.count_if(ok).alias("matched"), F.bool_and(ok).alias("ok")
    )
