"""Reading cubes: lookups, pivots, statistics, charts, search, permissions, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, periods


def lookup(cells: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The cells whose coordinates are listed."""
    return cells.join(keys.select(*on).distinct(), on, "left_semi")


def crosstab(cells: DataFrame, row: str, column: str, columns: list, value: str = "value") -> DataFrame:
    """One row for each member of ``row``, one column for each of ``columns``; the list is explicit, so no job looks for it."""
    return cells.groupBy(row).pivot(column, columns).agg(F.sum(value))


def with_total(table: DataFrame, columns: list[str], own: str | None = None) -> DataFrame:
    """Adds ``total``: the value that a parent column has of its own, else the sum of its leaf columns, null if all are."""
    parts = [F.col(c) for c in columns]
    some = F.coalesce(*parts).isNotNull()
    sum_ = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    total = F.when(some, sum_)
    return table.withColumn("total", total if own is None else F.coalesce(F.col(own), total))


def group_sum(cells: DataFrame, by: str, text: str = "value_str", digits: int = 2) -> DataFrame:
    """Sum by member of another axis; texts that are no numbers drop out, empty ones count 0, members without any number are left out."""
    x = F.when(F.trim(text) == "", F.lit(0.0)).otherwise(numbers.parsed(F.col(text)))
    return cells.groupBy(F.col(by).alias("label")).agg(F.sum(x).alias("s")).where("s is not null").select("label", numbers.rounded(F.col("s"), digits).alias("value"))


def series(cells: DataFrame, label: str, indicator: str, indicators: list, value: str = "value") -> DataFrame:
    """Chart series: a row for each label, a column for each indicator, 0 where there is nothing."""
    return cells.groupBy(F.col(label).alias("label")).pivot(indicator, indicators).agg(F.sum(value)).na.fill(0.0)


def pie(cells: DataFrame, row: str, value: str = "value") -> DataFrame:
    return cells.groupBy(row).agg(F.sum(value).alias("value")).where("value > 0")


def selection_stats(cells: DataFrame, text: str = "value_str") -> DataFrame:
    """One row: how many cells, how many numbers, their sum, mean, least and greatest."""
    x = numbers.parsed(F.col(text))
    return cells.agg(F.count("*").alias("cells"), F.count(x).alias("numbers"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def visible(cells: DataFrame, permissions: DataFrame, axes: dict[str, str], user: str, right: str = "can_view") -> DataFrame:
    """The cells that a user may see (or edit). An axis for which the user has rows is restricted to the granted members.

    ``axes`` gives the analytic of each key column; ``permissions(user_id, analytic_id, record_id, can_view, can_edit)``.
    """
    own = permissions.where(F.col("user_id") == user)
    restricted = own.agg(F.collect_set("analytic_id").alias("restricted"))
    out = cells.crossJoin(F.broadcast(restricted))  # one row
    for column, analytic in axes.items():
        granted = own.where((F.col("analytic_id") == analytic) & F.col(right)).select(F.col("record_id").alias(column)).distinct().withColumn("_ok", F.lit(True))
        out = out.join(granted, column, "left").where(F.col("_ok") | ~F.array_contains("restricted", analytic)).drop("_ok")
    return out.select(*cells.columns)


def accessible(items: DataFrame, permissions: DataFrame, key: str, user: str) -> DataFrame:
    """Items that a user may see; without a row they are visible."""
    own = permissions.where(F.col("user_id") == user).select(key, "can_view")
    return items.join(own, key, "left").where("coalesce(can_view, true)").drop("can_view")


def at_least_level(records: DataFrame, least: str) -> DataFrame:
    """Periods of a level or coarser; records without a period key stay."""
    rank = periods.rank(F.col("period_key"))
    return records.where(rank.isNull() | (rank >= periods.LEVELS[least]))


def editable(locked: Column, rule: Column, data_mode: Column) -> Column:
    return ~F.coalesce(locked, F.lit(False)) & data_mode & (F.coalesce(rule, F.lit("manual")) == "manual")


def carried(rows: DataFrame, by: list[str], order: str, value: str) -> Column:
    """The last value that isn't null, up to the present row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def finest_per_year(keys: DataFrame) -> DataFrame:
    """Adds ``is_total``: whether the year has a finer key than this one."""
    rank = periods.rank(F.col("period_key"))
    least = F.min(rank).over(Window.partitionBy(F.substring("period_key", 1, 4)))
    return keys.withColumn("is_total", rank > least)


def between_rows(ranges: DataFrame, rows: DataFrame, width: int = 1000) -> DataFrame:
    """``(range_id, total, n)`` of ``rows(sheet_id, row, value)`` within ``ranges(range_id, sheet_id, low, high)``.

    Rows meet ranges by blocks of ``width`` rows, so this is an equi-join whatever the ranges are.
    """
    parts = ranges.withColumn("b", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    both = parts.join(rows.withColumn("b", F.floor(F.col("row") / width)), ["sheet_id", "b"]).where("row between low and high")
    return both.groupBy("range_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def compared(ours: DataFrame, theirs: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """``(keys, value, expected, error, ok)`` of the cells that both have."""
    both = ours.select(*keys, "value").join(theirs.select(*keys, F.col("value").alias("expected")), keys)
    return both.withColumn("error", numbers.relative_error(F.col("value"), F.col("expected"))).withColumn("ok", F.col("error") <= tolerance)


def translated(items: DataFrame, translations: DataFrame, key: str, lang: str, field: str = "name") -> DataFrame:
    """``field`` in a language, the original where there is no translation; ``translations(entity_id, field, lang, value)``."""
    own = translations.where((F.col("lang") == lang) & (F.col("field") == field)).select(F.col("entity_id").alias(key), F.col("value").alias("_t"))
    return items.join(own, key, "left").withColumn(field, F.coalesce("_t", field)).drop("_t")


def described(cells: DataFrame, records: DataFrame, coord: str = "coord") -> DataFrame:
    """Adds ``place``: the names of a cell's members in axis order, joined by `` · ``."""
    parts = cells.select("sheet_id", coord, F.posexplode(coord).alias("i", "record_id")).join(records.select("record_id", "name"), "record_id")
    named = parts.groupBy("sheet_id", coord).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), " · ").alias("place"))
    return cells.join(named, ["sheet_id", coord], "left")


def report_lines(cells: DataFrame, records: DataFrame, most: int = 2000) -> DataFrame:
    """A sheet as text, ``name | name: value``, its first ``most`` lines (a report's length)."""
    line = F.concat(F.replace(F.col("place"), F.lit(" · "), F.lit(" | ")), F.lit(": "), F.coalesce("value_str", F.lit("")))
    return described(cells, records).select("sheet_id", line.alias("line")).orderBy("sheet_id", "line").limit(most)


def rejected(edits: DataFrame, permissions: DataFrame, axes: dict[str, str], user: str, keys: list[str]) -> DataFrame:
    """Edits that a user may not make: those of cells outside the members whose editing is granted."""
    return edits.join(visible(edits, permissions, axes, user, "can_edit").select(*keys).distinct(), keys, "left_anti")


def shown_members(records: DataFrame, least: str, listed: Column | None = None) -> DataFrame:
    """Members that a sheet shows: those of an explicit list where it has one, else periods of a level or coarser; ``listed`` is an array of ids or null."""
    rank = periods.rank(F.col("period_key"))
    by_level = rank.isNull() | (rank >= periods.LEVELS[least])
    return records.where(by_level if listed is None else F.coalesce(F.array_contains(listed, F.col("record_id")), by_level))


def pinned(cells: DataFrame, axis: str, member) -> DataFrame:
    """The slice of a cube at one member, without the axis."""
    return cells.where(F.col(axis) == member).drop(axis)


def with_members(cells: DataFrame, one, other, coord: str = "coord") -> DataFrame:
    """Cells whose coordinates hold two members, wherever they stand."""
    return cells.where(F.array_contains(coord, one) & F.array_contains(coord, other))


def longest_prefix(asked: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """``(coord, value)``: for each asked coordinate the value of the longest known one that it begins with, of ``least`` members or more."""
    n = F.size("coord")
    cut = asked.where(n >= least).select("coord", F.explode(F.transform(F.sequence(F.lit(least), n), lambda k: F.slice("coord", 1, k))).alias("part"))
    # Spark takes an array column for one element wide: without the hint it would broadcast millions of coordinates.
    met = cut.join(known.select(F.col("coord").alias("part"), "value").hint("merge"), "part")
    return met.groupBy("coord").agg(F.max_by("value", F.size("part")).alias("value"))


def expanded(cells: DataFrame, records: DataFrame, axis: str, parent) -> DataFrame:
    """The cells of a member's direct children along one axis, as they are fetched when it is opened."""
    kids = records.where(F.col("parent_id") == parent).select(F.col("record_id").alias(axis))
    return cells.join(kids, axis, "left_semi")


def grid(facts: DataFrame, row: str, column: str, rows: DataFrame, columns: DataFrame, shown: list, value: str = "value") -> DataFrame:
    """Pivot grid: a row for each node of ``rows``, a column for each of the nodes ``shown`` of ``columns`` (closures), coarser ones holding their totals."""
    from .rollup import roll_up

    return crosstab(roll_up(facts, {row: rows, column: columns}, [value]), row, column, shown, value)


def mismatches(both: DataFrame, most: int = 30) -> DataFrame:
    """The ``most`` cells (a report's length) of ``compared`` that differ most."""
    return both.where(~F.col("ok")).orderBy(F.desc("error"), *[c for c in both.columns if c not in ("value", "expected", "error", "ok")]).limit(most)


def as_json(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells as JSON texts, one a row; what is missing is left out."""
    return cells.select(*keys, F.to_json(F.struct(*cells.columns)).alias("json"))


def counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """How many cells and how many formulas each sheet has."""
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if(F.col("rule") == "formula").alias("formulas"))


def members_with_rights(records: DataFrame, analytics: DataFrame, models: DataFrame, permissions: DataFrame, user: str) -> DataFrame:
    """Members of all models with their dimension's and model's name and a user's rights, which are none where nothing is granted."""
    own = permissions.where(F.col("user_id") == user).select("record_id", "can_view", "can_edit")
    named = records.join(analytics.select("analytic_id", "model_id", F.col("name").alias("analytic")), "analytic_id").join(models.select("model_id", F.col("name").alias("model")), "model_id")
    rights = [F.coalesce(c, F.lit(False)).alias(c) for c in ("can_view", "can_edit")]
    return named.join(own, "record_id", "left").select("record_id", "name", "analytic", "model", *rights)


def sheet_bundle(sheets: DataFrame, axes: DataFrame, records: DataFrame, settings: DataFrame) -> DataFrame:
    """All that a sheet needs to be shown: a row for each member of each of its axes, with the sheet's name and its settings.

    ``settings(sheet_id, json)`` may be missing. Members aren't packed into arrays, so a dimension of any size passes.
    """
    members = axes.join(records.select("analytic_id", "record_id", "parent_id", "sort_order", F.col("name").alias("member")), "analytic_id")
    return sheets.select("sheet_id", F.col("name").alias("sheet")).join(settings, "sheet_id", "left").join(members, "sheet_id").select(
        "sheet_id", "sheet", F.col("json").alias("settings"), "axis_idx", "analytic_id", "is_main", "record_id", "parent_id", "sort_order", "member"
    )


def model_tree(models: DataFrame, sheets: DataFrame, analytics: DataFrame) -> DataFrame:
    """``(model_id, name, sheets, analytics)``: each model with the names of its sheets and dimensions in order."""
    names = lambda df, as_: df.groupBy("model_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sort_order", "name"))), lambda x: x["name"]).alias(as_))
    none = F.array().cast("array<string>")
    both = models.join(names(sheets, "sheets"), "model_id", "left").join(names(analytics, "analytics"), "model_id", "left")
    return both.withColumns({c: F.coalesce(c, none) for c in ("sheets", "analytics")}).select("model_id", "name", "sheets", "analytics")
