"""Indicator rules: choosing, deriving, promoting and spreading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_rule(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One of the matching rules of each cell: priority descending, larger scope, smaller id."""
    order = Window.partitionBy(*by).orderBy(F.desc("priority"), F.desc("scope_size"), "rule_id")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def formula_groups(cells: DataFrame, members: list[str]) -> DataFrame:
    """Cells by formula: how many, and the distinct members of each axis, most cells first in ``rank``."""
    sets = [F.sort_array(F.collect_set(m)).alias(m) for m in members]
    groups = cells.groupBy("formula").agg(F.count("*").alias("n_cells"), *sets)
    return groups.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_cells"), "formula")))


def formula_of_indicator(cells: DataFrame, by: list[str]) -> DataFrame:
    """The formula that all cells of an indicator share, or ``__per_cell__``."""
    one = F.when(F.count_distinct("formula") == 1, F.min("formula")).otherwise(F.lit("__per_cell__"))
    return cells.where("formula is not null").groupBy(*by).agg(one.alias("formula"))


def derived_rules(cells: DataFrame, main: str, axes: list[str]) -> DataFrame:
    """Rules from formulas of single cells: the most frequent one of an indicator is its leaf rule, others are scoped to their members.

    Returns ``(indicator_id, kind, formula, priority, scope)``; scoped priorities rise with the cells that a formula has.
    """
    lists = [F.array_join(F.sort_array(F.collect_set(F.col(a).cast("string"))), ",").alias(a) for a in axes]
    groups = cells.where("formula is not null").groupBy(F.col(main).alias("indicator_id"), "formula").agg(F.count("*").alias("n"), *lists)
    rank = F.row_number().over(Window.partitionBy("indicator_id").orderBy(F.desc("n"), "formula"))
    scope = F.map_from_arrays(F.array(*map(F.lit, axes)), F.array(*map(F.col, axes)))
    groups = groups.withColumn("r", rank)
    first = F.col("r") == 1
    return groups.select(
        "indicator_id", F.when(first, "leaf").otherwise("scoped").alias("kind"), "formula",
        F.when(first, 0).otherwise(F.col("n")).cast("long").alias("priority"), F.when(~first, scope).alias("scope"),
    )


def promoted(rules: DataFrame, cell: DataFrame) -> DataFrame:
    """``rules`` and one scoped rule from each of ``cell(rule_id, sheet_id, indicator_id, scope, priority, formula)``.

    Its priority is at least ten above the highest of the indicator.
    """
    top = rules.groupBy("sheet_id", "indicator_id").agg(F.max("priority").alias("top"))
    new = cell.join(top, ["sheet_id", "indicator_id"], "left").withColumn("priority", F.greatest("priority", F.coalesce("top", F.lit(0)) + 10)).drop("top")
    return rules.unionByName(new.withColumn("kind", F.lit("scoped")).select(*rules.columns))


def spread(rules: DataFrame, indicators: DataFrame) -> DataFrame:
    """Consolidation rules for indicators that have none, from the first rule of an indicator with the same name.

    ``indicators(sheet_id, indicator_id, name)``; rules that are there stay as they are.
    """
    own = rules.where("kind = 'consolidation'")
    named = own.join(indicators, ["sheet_id", "indicator_id"])
    source = named.groupBy(F.lower("name").alias("k")).agg(F.min_by(F.struct("formula", "priority", "scope"), F.struct("sheet_id", "indicator_id", "rule_id")).alias("r"))
    lacking = indicators.join(own.select("sheet_id", "indicator_id"), ["sheet_id", "indicator_id"], "left_anti").withColumn("k", F.lower("name"))
    new = lacking.join(source, "k").select(
        F.concat_ws(":", F.lit("spread"), "sheet_id", F.col("indicator_id").cast("string")).alias("rule_id"), "sheet_id", "indicator_id",
        F.lit("consolidation").alias("kind"), F.col("r.scope").alias("scope"), F.col("r.priority").alias("priority"), F.col("r.formula").alias("formula"),
    )
    return rules.unionByName(new.select(*rules.columns))


def source_label(own: Column, manual: Column, rule_id: Column, inner: Column) -> Column:
    """Where a cell's formula comes from."""
    return F.when(own, "cell").when(manual, "cell-manual").when(rule_id.isNotNull(), F.concat(F.lit("rule:"), rule_id)).when(inner, "default-sum").otherwise("manual")


def in_order(rules: DataFrame, indicator: int | None = None) -> DataFrame:
    """Rules as they are listed: by indicator, highest priority first, then by age."""
    own = rules if indicator is None else rules.where(F.col("indicator_id") == indicator)
    order = Window.partitionBy("sheet_id", "indicator_id").orderBy(F.desc("priority"), "rule_id")
    return own.withColumn("place", F.row_number().over(order))


def replaced(rules: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rules instead of all that their indicators had."""
    return rules.join(new.select("sheet_id", "indicator_id").distinct(), ["sheet_id", "indicator_id"], "left_anti").unionByName(new.select(*rules.columns))


def released(cells: DataFrame, promoted_cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells(.., rule, formula)`` after the formulas of some became rules: those cells follow the rules from then on."""
    hit = promoted_cells.select(*keys).distinct().withColumn("_p", F.lit(True))
    both = cells.join(hit, keys, "left")
    return both.withColumns({"formula": F.when(F.col("_p"), F.lit(None).cast("string")).otherwise(F.col("formula")), "rule": F.when(F.col("_p"), "formula").otherwise(F.col("rule"))}).select(*cells.columns)


def displayed(model) -> DataFrame:
    """``(sheet_id, coord, formula, source, kind)`` of every cell: the formula that it shows and where that comes from."""
    from . import calc

    return calc.resolve(model, calc.enumerate_cells(model)).select("sheet_id", "coord", "formula", "source", "kind")
