"""The general calculation: cells with values, formulas and rules at any node, evaluated along their dependencies.

1. ``enumerate_cells``: stored cells, a cell for each indicator with a rule in every context that is there, and all nodes above.
2. ``resolve``: which formula applies: the cell's own, none for manual cells, the best matching scoped rule, the consolidation
   rule on inner nodes or the leaf rule on leaves, and else the sum of the children along one axis (period, main, others).
3. ``bind``: references of each distinct formula as rows, joined to names, periods and sheets: a table of edges.
4. ``evaluate``: rounds of joins; in each, all cells whose references have arrived get their values by compiled columns.
   Rounds are as many as dependencies are deep, never as many as cells; chains of cells that are linear in one another, such as
   balances over time, are composed by doubling jumps. Each round ends in a written table.

Only distinct formula texts, which are metadata, come to the driver. Cells of cycles have status ``cycle`` and value 0; cells that
refer to a name which is not there have status ``unresolved``.

Coordinates are arrays with one record id for each axis of the sheet, in axis order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import numbers, periods
from ..functions.formula import EMPTY, KEYWORDS, linear_in, parse, references, to_column
from ..session import materialized
from . import hierarchy

KEY = ["sheet_id", "coord"]
#: Formulas that one projection evaluates.
CHUNK = 100
#: Rounds after which chains are looked for.
ROUNDS_TO_CHAINS = (1, 8, 64, 512)
#: Steps that an edit's dependents are followed.
DEEP = 8


@dataclass(frozen=True)
class Model:
    """A planning model.

    sheets(sheet_id, name, excel_code); axes(sheet_id, axis_idx, analytic_id, name, is_main, is_period);
    records(record_id, analytic_id, parent_id, sort_order, name, period_key, excel_row);
    cells(sheet_id, coord, value_str, rule, formula) with rule manual, formula, sum_children or empty;
    rules(rule_id, sheet_id, indicator_id, kind, scope, priority, formula), scope a map of analytic ids to member ids a,b,c.
    """

    sheets: DataFrame
    axes: DataFrame
    records: DataFrame
    cells: DataFrame
    rules: DataFrame


@dataclass(frozen=True)
class Calculated:
    """values(sheet_id, coord, value, old, kind, source, status, was_empty) and edges(sheet_id, coord, ref_no, to_sheet, to_coord, own)."""

    values: DataFrame
    edges: DataFrame
    todo: DataFrame


def _put(coord: Column | str, at: Column, value: Column) -> Column:
    return F.transform(coord, lambda x, i: F.when(i == at, value).otherwise(x))


def sheet_axes(model: Model) -> DataFrame:
    """``(sheet_id, ax)`` with the axes of each sheet as an array in order, and the number of the main one."""
    each = F.struct("axis_idx", F.lower("name").alias("name"), "analytic_id", "is_main", "is_period")
    return model.axes.groupBy("sheet_id").agg(F.sort_array(F.collect_list(each)).alias("ax"), F.max(F.when(F.col("is_main"), F.col("axis_idx"))).alias("main"))


def enumerate_cells(model: Model, dense: bool = False, tree: DataFrame | None = None) -> DataFrame:
    """``(sheet_id, coord, kids, ax, main)`` of every cell; kids tells for each axis whether the member has children.

    Contexts of rule indicators are those of stored cells; with ``dense`` all combinations of leaves, whose number
    is the product of the axes' sizes.
    """
    axes, records, most = sheet_axes(model), hierarchy.with_kids(model.records), _most_axes(model)
    stored = model.cells.select(*KEY).join(axes, "sheet_id")
    indicators = model.rules.select("sheet_id", F.col("indicator_id").alias("i")).distinct()
    if dense:
        members = model.axes.where("not is_main").join(hierarchy.leaves(model.records), "analytic_id").groupBy("sheet_id", "axis_idx").agg(F.collect_list("record_id").alias("ids"))
        start = axes.where("main is not null").withColumn("coord", F.transform("ax", lambda _: F.lit(None).cast("long")))
        for k in range(most):
            own = members.where(F.col("axis_idx") == k).select("sheet_id", "ids")
            start = start.join(own, "sheet_id", "left").withColumn("m", F.explode_outer("ids")).withColumn("coord", F.when(F.col("m").isNotNull(), _put("coord", F.lit(k), F.col("m"))).otherwise(F.col("coord"))).drop("ids", "m")
        contexts = start
    else:
        contexts = stored.where("main is not null").withColumn("coord", _put("coord", F.col("main"), F.lit(None).cast("long"))).dropDuplicates(KEY)
    ruled = contexts.join(indicators, "sheet_id").withColumn("coord", _put("coord", F.col("main"), F.col("i"))).drop("i")
    cells = stored.unionByName(ruled.select(*stored.columns)).dropDuplicates(KEY)
    tree = (hierarchy.closure(model.records) if tree is None else tree).join(records.select(F.col("record_id").alias("anc"), "has_kids", "analytic_id"), "anc")
    up = model.axes.select("sheet_id", "axis_idx", "analytic_id").join(tree, "analytic_id").select("sheet_id", "axis_idx", "desc", "anc", "has_kids")
    cells = cells.withColumn("kids", F.transform("coord", lambda _: F.lit(False)))
    for k in range(most):
        own = up.where(F.col("axis_idx") == k).select("sheet_id", F.col("desc").alias("m"), "anc", "has_kids")
        cells = cells.withColumn("m", F.get("coord", F.lit(k))).join(own, ["sheet_id", "m"], "left")
        there = F.col("anc").isNotNull()
        cells = cells.withColumn("coord", F.when(there, _put("coord", F.lit(k), F.col("anc"))).otherwise(F.col("coord")))
        cells = cells.withColumn("kids", F.when(there, _put("kids", F.lit(k), F.col("has_kids"))).otherwise(F.col("kids"))).drop("m", "anc", "has_kids")
    return cells.dropDuplicates(KEY)


def _most_axes(model: Model) -> int:
    return (model.axes.agg(F.max("axis_idx")).first()[0] or 0) + 1


def in_scope(scope: Column, ax: Column, coord: Column) -> Column:
    """Whether every scoped axis has one of the listed members."""
    return F.forall(
        F.map_entries(scope),
        lambda e: F.exists(ax, lambda x: (x["analytic_id"] == e["key"]) & F.array_contains(F.split(e["value"], r"\s*,\s*"), F.get(coord, x["axis_idx"]).cast("string"))),
    )


def resolve(model: Model, cells: DataFrame) -> DataFrame:
    """Adds ``stored, manual, formula, source, kind, axis`` to enumerated cells.

    source labels where the formula comes from: ``cell``, ``rule:<id>``, ``default-sum``, ``manual``, ``cell-empty`` or
    ``stored``. kind is formula, SUM, AVERAGE, LAST or stored; axis is the one that SUM, AVERAGE and LAST expand.
    """
    own = model.cells.select(*KEY, "value_str", F.col("rule").alias("cell_rule"), F.col("formula").alias("cell_formula"))
    cells = cells.join(own, KEY, "left")
    inner = F.exists("kids", lambda k: k)
    text = F.trim(F.coalesce("cell_formula", F.lit("")))
    has_own = (F.col("cell_rule") == "formula") & (text != "") & ~text.startswith("=")
    # Formulas without a text of their own, sums and empty cells follow the rules; everything else that is stored is manual.
    manual = F.col("cell_rule").isNotNull() & ~F.col("cell_rule").isin("sum_children", "empty") & ~((F.col("cell_rule") == "formula") & ((text == "") | has_own))
    cells = cells.withColumns({"inner": inner, "has_own": F.coalesce(has_own, F.lit(False)), "manual": F.coalesce(manual, F.lit(False)), "indicator_id": F.get("coord", F.col("main"))})
    rules = model.rules.where("trim(coalesce(formula, '')) <> ''").select("sheet_id", "indicator_id", "rule_id", F.col("kind").alias("rule_kind"), "scope", "priority", F.trim("formula").alias("rule_formula"))
    fit = (
        F.when(F.col("rule_kind") == "scoped", (F.size("scope") > 0) & in_scope(F.col("scope"), F.col("ax"), F.col("coord")))
        .when(F.col("rule_kind") == "consolidation", F.col("inner"))
        .otherwise(~F.col("inner"))
    )
    order = F.struct((F.col("rule_kind") != "scoped").alias("a"), (-F.col("priority")).alias("b"), (-F.size("scope")).alias("c"), F.col("rule_id").alias("rule_id"), F.col("rule_formula").alias("f"))
    asked = cells.where(~F.col("has_own") & ~F.col("manual")).select(*KEY, "ax", "inner", "indicator_id")
    best = asked.join(rules, ["sheet_id", "indicator_id"]).where(fit).groupBy(*KEY).agg(F.min(order).alias("best"))
    cells = cells.join(best, KEY, "left")
    formula = F.when(F.col("has_own"), F.trim("cell_formula")).when(~F.col("manual"), F.col("best.f"))
    word = F.upper(formula).isin(*KEYWORDS)
    cells = cells.withColumn("formula", formula)
    emptied = F.coalesce(F.lower("formula") == EMPTY, F.lit(False))
    kind = (
        F.when(emptied, "stored")
        .when(word & F.col("inner"), F.upper("formula"))
        .when(F.col("formula").isNotNull() & ~word, "formula")
        .when(F.col("inner") & ~F.col("manual") & (F.coalesce("cell_rule", F.lit("")) != "empty"), "SUM")
        .otherwise("stored")
    )
    source = (
        F.when(emptied, "cell-empty")
        .when(F.col("has_own"), "cell")
        .when(F.col("manual"), "manual")
        .when(F.col("best").isNotNull(), F.concat(F.lit("rule:"), F.col("best.rule_id")))
        .when(F.col("cell_rule") == "empty", "cell-empty")
        .when(F.col("inner"), "default-sum")
        .otherwise("stored")
    )
    open_ = F.filter("ax", lambda x: F.get("kids", x["axis_idx"]))
    axis = F.array_min(F.transform(open_, lambda x: F.struct(F.when(x["is_period"], 0).when(x["is_main"], 1).otherwise(2).alias("p"), x["axis_idx"].alias("i")))).getField("i")
    value = F.when((F.coalesce(F.col("cell_rule"), F.lit("")) != "empty") & ~emptied, numbers.parsed(F.col("value_str")))
    return cells.select(*KEY, "ax", "main", value.alias("stored"), "manual", "formula", source.alias("source"), kind.alias("kind"), axis.alias("axis"))


def _distinct_formulas(cells: DataFrame) -> list[str]:
    return sorted(r[0] for r in cells.where("kind = 'formula'").select("formula").distinct().collect())


_REFS = "formula string, ref_no int, r_sheet string, chain array<string>, r_row int, params array<struct<axis:string,shift:int,member:string>>"


def _reference_table(model: Model, formulas: list[str]) -> DataFrame:
    rows = []
    for text in formulas:
        for k, r in enumerate(references(parse(text))):
            rows.append((text, k, r.sheet, list(r.chain), r.row, [(p.axis, p.shift, p.member) for p in r.params]))
    return model.records.sparkSession.createDataFrame(rows, _REFS)


def _local_targets(asked: DataFrame, names: DataFrame, tree: DataFrame) -> DataFrame:
    """Adds ``axis_idx, found`` by name on the target sheet. Of several candidates: first axis, row hint, nearness, order.

    Near are records with the own member's parent, then its grandparent, then its own children.
    """
    leaf = F.element_at("chain", -1)
    found = asked.withColumn("leaf", leaf).join(names.withColumnRenamed("sheet_id", "t_sheet").withColumnRenamed("n_name", "leaf"), ["t_sheet", "leaf"])
    n = F.size("chain")
    found = found.where((n == 1) | ((F.size("n_path") >= n) & (F.slice("n_path", F.size("n_path") - n + 1, n) == F.col("chain"))))
    own = F.when(F.col("t_sheet") == F.col("sheet_id"), F.get("coord", F.col("axis_idx")))
    found = found.withColumn("own", own).join(tree, F.col("own") == F.col("o_id"), "left")
    near = (
        F.when(F.col("n_row") == F.col("r_row"), 0)
        .when(F.col("n_parent").eqNullSafe(F.col("o_parent")) & F.col("own").isNotNull(), 1)
        .when(F.col("n_parent") == F.col("o_grand"), 2)
        .when(F.col("n_parent") == F.col("own"), 3)
        .otherwise(4)
    )
    rank = F.struct("axis_idx", near.alias("near"), "n_sort", F.col("n_id").alias("found"))
    return found.groupBy(*KEY, "ref_no").agg(F.min(rank).alias("best"))


def bind(model: Model, cells: DataFrame, tree: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Edges ``(sheet_id, coord, ref_no, to_sheet, to_coord, own)`` of resolved cells, and the distinct formulas.

    ref_no numbers the references of a formula, or the children by order. A target that isn't known is null. Across sheets the
    period is translated by its key, with the year as fallback, and every other axis stands on its first leaf.
    """
    formulas = _distinct_formulas(cells)
    refs = _reference_table(model, formulas)
    sheets = model.sheets.select(F.col("sheet_id").alias("t_sheet"), F.array_distinct(F.array(F.lower("name"), F.lower(F.coalesce("excel_code", "name")))).alias("ns"))
    named = sheets.select("t_sheet", F.posexplode("ns").alias("pos", "r_sheet")).groupBy("r_sheet").agg(F.min_by("t_sheet", F.struct("pos", "t_sheet")).alias("t_sheet"))
    axes = sheet_axes(model)
    asked = cells.where("kind = 'formula'").select(*KEY, "ax", "formula").join(refs, "formula").join(named, "r_sheet", "left")
    asked = asked.withColumn("t_sheet", F.when(F.col("r_sheet").isNull(), F.col("sheet_id")).otherwise(F.col("t_sheet"))).drop("formula")
    asked = asked.join(axes.select(F.col("sheet_id").alias("t_sheet"), F.col("ax").alias("t_ax")), "t_sheet", "left")
    ordered = hierarchy.in_tree_order(model.records, tree)
    names = ordered.select("analytic_id", F.col("record_id").alias("n_id"), F.col("parent_id").alias("n_parent"), F.col("sort_order").alias("n_sort"), F.col("excel_row").alias("n_row"), F.lower(F.trim("name")).alias("n_name"), F.transform("names", lambda x: F.lower(F.trim(x))).alias("n_path"))
    names = model.axes.where("not is_period").select("sheet_id", "axis_idx", "analytic_id").join(names, "analytic_id").drop("analytic_id")
    up = model.records.select(F.col("record_id").alias("o_parent"), F.col("parent_id").alias("o_grand"))
    above = model.records.select(F.col("record_id").alias("o_id"), F.col("parent_id").alias("o_parent")).join(up, "o_parent", "left").select("o_id", "o_parent", "o_grand")
    best = _local_targets(asked, names, above)
    asked = asked.join(best, [*KEY, "ref_no"], "left")
    # Base coordinate: the own one, or across sheets first leaves with the period translated.
    first = model.axes.join(hierarchy.first_leaves(model.records), "analytic_id").groupBy("sheet_id").agg(F.sort_array(F.collect_list(F.struct("axis_idx", "record_id"))).alias("fl"))
    asked = asked.join(first.select(F.col("sheet_id").alias("t_sheet"), "fl"), "t_sheet", "left")
    period_at = lambda ax: F.array_min(F.transform(F.filter(ax, lambda x: x["is_period"]), lambda x: x["axis_idx"]))
    asked = asked.withColumns({"s_at": period_at("ax"), "t_at": period_at("t_ax")}).withColumn("s_period", F.get("coord", F.col("s_at")))
    keys = model.records.where("period_key is not null").select(F.col("record_id").alias("s_period"), "period_key")
    on_axis = model.axes.where("is_period").select(F.col("sheet_id").alias("t_sheet"), "analytic_id").join(model.records.select("analytic_id", F.col("record_id").alias("p_id"), F.lower("period_key").alias("k")), "analytic_id").drop("analytic_id")
    asked = asked.join(keys, "s_period", "left")
    by = lambda key, name: on_axis.where("k is not null").groupBy("t_sheet", "k").agg(F.min("p_id").alias(name)).withColumnRenamed("k", key)
    asked = asked.withColumns({"k1": F.lower("period_key"), "k2": F.lower(periods.key_at(periods.start(F.col("period_key")), "Y"))})
    asked = asked.join(by("k1", "p1"), ["t_sheet", "k1"], "left").join(by("k2", "p2"), ["t_sheet", "k2"], "left")
    same = on_axis.select("t_sheet", F.col("p_id").alias("s_period"), F.col("p_id").alias("p0"))
    asked = asked.join(same, ["t_sheet", "s_period"], "left").withColumn("p", F.coalesce("p0", "p1", "p2"))
    away = F.transform("fl", lambda x: F.when(x["axis_idx"] == F.col("t_at"), F.col("p")).otherwise(x["record_id"]))
    base = F.when(F.col("r_sheet").isNull(), F.col("coord")).otherwise(away)
    to = F.when(F.col("best").isNotNull(), _put(base, F.col("best.axis_idx"), F.col("best.found")))
    asked = asked.withColumn("to_coord", to)
    moved = _with_params(model, asked)
    own = (F.col("to_sheet") == F.col("sheet_id")) & (F.col("to_coord") == F.col("coord"))
    edges = moved.withColumn("own", F.coalesce(own, F.lit(False)))
    kids = model.records.where("parent_id is not null").select(F.col("parent_id").alias("p"), F.col("record_id").alias("child"), "sort_order")
    parts = cells.where("kind in ('SUM', 'AVERAGE', 'LAST')").withColumn("p", F.get("coord", F.col("axis"))).join(kids, "p")
    parts = parts.select(*KEY, F.col("sort_order").cast("int").alias("ref_no"), F.col("sheet_id").alias("to_sheet"), _put("coord", F.col("axis"), F.col("child")).alias("to_coord"), F.lit(False).alias("own"))
    return edges.select(*parts.columns).union(parts), formulas


def _with_params(model: Model, asked: DataFrame) -> DataFrame:
    """Applies the axis overrides; one that runs off its chain or names no period gives a null target."""
    keep = asked.select(*KEY, "ref_no", F.col("t_sheet").alias("to_sheet"), "to_coord")
    rows = asked.where("to_coord is not null and size(params) > 0").select(*KEY, "ref_no", "t_sheet", "t_ax", "to_coord", F.explode("params").alias("q"))
    exact = F.filter("t_ax", lambda x: x["name"] == F.col("q.axis"))
    part = F.filter("t_ax", lambda x: F.contains(x["name"], F.col("q.axis")) | F.contains(F.col("q.axis"), x["name"]))
    axis = F.when(F.size(exact) > 0, F.get(exact, F.lit(0))).when(F.size(part) == 1, F.get(part, F.lit(0)))
    rows = rows.withColumn("x", axis).where("x is not null").withColumn("m", F.get("to_coord", F.col("x.axis_idx")))
    chains = hierarchy.period_chains(model.records)
    at = chains.select(F.col("record_id").alias("m"), "level", "idx", F.col("analytic_id").alias("c_an"))
    to = chains.select(F.col("analytic_id").alias("c_an"), "level", F.col("idx").alias("to_idx"), F.col("record_id").alias("by_shift"))
    rows = rows.join(at, "m", "left").withColumn("to_idx", F.col("idx") + F.col("q.shift")).join(to, ["c_an", "level", "to_idx"], "left")
    names = model.records.select("analytic_id", "record_id", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("name"), F.lower("period_key"))))).alias("n"))
    names = names.groupBy("analytic_id", "n").agg(F.min("record_id").alias("by_name"))
    rows = rows.withColumns({"analytic_id": F.col("x.analytic_id"), "n": F.col("q.member")}).join(names, ["analytic_id", "n"], "left")
    # An unknown member of a plain axis leaves the coordinate as it is; an unknown period is missing.
    new = F.when(F.col("q.shift").isNotNull(), F.col("by_shift")).otherwise(F.coalesce("by_name", F.when(~F.col("x.is_period"), F.col("m"))))
    rows = rows.select(*KEY, "ref_no", F.struct(F.col("x.axis_idx").alias("i"), new.alias("v")).alias("put"))
    puts = rows.groupBy(*KEY, "ref_no").agg(F.collect_list("put").alias("puts"))
    keep = keep.join(puts, [*KEY, "ref_no"], "left")
    moved = F.aggregate("puts", F.col("to_coord"), lambda c, p: _put(c, p["i"], p["v"]))
    lost = F.exists("puts", lambda p: p["v"].isNull())
    target = F.when(F.col("puts").isNull(), F.col("to_coord")).when(~lost, moved)
    return keep.withColumn("to_coord", target).drop("puts")


def _value(formulas: list[str]) -> Column:
    """The value of a cell: of SUM, AVERAGE and LAST from aggregates, of formulas from ``refs``, a map of reference numbers to values."""
    out = F.when(F.col("kind") == "SUM", F.coalesce("total", F.lit(0.0))).when(F.col("kind") == "AVERAGE", F.coalesce(F.try_divide("total", "n"), F.lit(0.0))).when(F.col("kind") == "LAST", F.coalesce("last.v", F.lit(0.0)))
    for text in formulas:
        node = parse(text)
        order = {r: k for k, r in enumerate(references(node))}
        out = out.when(F.col("formula") == text, to_column(node, lambda r, order=order: F.element_at("refs", F.lit(order[r]))))
    return out


def _with_values(ready: DataFrame, formulas: list[str]) -> DataFrame:
    """Adds ``value`` where ``ready``. With many formulas the cells are written once, by formula, and each projection reads its own."""
    if len(formulas) <= CHUNK:
        return ready.withColumn("value", F.when(F.col("ready"), _value(formulas)))
    spark = ready.sparkSession
    numbered = spark.createDataFrame([(t, i // CHUNK) for i, t in enumerate(formulas)], "formula string, chunk int")
    ready = materialized(ready.join(numbered, "formula", "left").fillna(0, ["chunk"]), "ready", "chunk")
    parts = [ready.where(F.col("chunk") == k).withColumn("value", F.when(F.col("ready"), _value(formulas[k * CHUNK : (k + 1) * CHUNK]))) for k in range(-(-len(formulas) // CHUNK))]
    return reduce(DataFrame.union, parts).drop("chunk")


_PARTIAL = ("n", "total", "last", "refs")


def _gathered(arrivals: DataFrame) -> DataFrame:
    """``(sheet_id, coord, n, total, last, refs)``: what has arrived for each cell. Children are summed; only formulas, with a few references each, gather theirs."""
    return arrivals.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max_by("last", "last.ref_no").alias("last"), F.flatten(F.collect_list("refs")).alias("refs")
    )


def _arrivals(edges: DataFrame) -> DataFrame:
    """Edges with a value ``v`` as rows that ``_gathered`` adds up."""
    one = F.struct("ref_no", "v")
    none = F.array().cast("array<struct<ref_no:int,v:double>>")
    return edges.select(*KEY, F.lit(1).cast("long").alias("n"), F.coalesce("v", F.lit(0.0)).alias("total"), F.struct("ref_no", F.coalesce("v", F.lit(0.0)).alias("v")).alias("last"), F.when(F.col("gather"), F.array(one)).otherwise(none).alias("refs"))


def _chains(open_: DataFrame, waiting: DataFrame, formulas: list[str]) -> DataFrame:
    """``(sheet_id, coord, to_sheet, to_coord, a, b)``: cells whose value is a * value(to) + b, to being none of them.

    ``open_(.., kind, formula, needed, n, total, last, refs)`` are the cells without a value. Of those that wait for one reference only, and are linear in it, chains
    (balances over time, say) are composed by jumps that double, so a chain of any length takes the logarithm of it in rounds.
    """
    target = open_.select(F.col("sheet_id").alias("to_sheet"), F.col("coord").alias("to_coord"))
    one = open_.where(F.col("needed") - F.col("n") == 1).join(waiting.select(*KEY, "ref_no", "to_sheet", "to_coord"), KEY).join(target, ["to_sheet", "to_coord"], "left_semi")
    kind, after = F.col("kind"), F.coalesce(F.col("ref_no") > F.col("last.ref_no"), F.lit(True))
    a = F.when(kind == "SUM", F.lit(1.0)).when(kind == "AVERAGE", 1.0 / F.col("needed")).when(kind == "LAST", after.cast("double"))
    b = F.when(kind == "SUM", F.coalesce("total", F.lit(0.0))).when(kind == "AVERAGE", F.coalesce("total", F.lit(0.0)) / F.col("needed")).when(kind == "LAST", F.when(after, 0.0).otherwise(F.col("last.v")))
    for text in formulas:
        node = parse(text)
        order = {r: k for k, r in enumerate(references(node))}
        for r, k in order.items():
            if linear := linear_in(node, r, lambda x, order=order: F.element_at("refs", F.lit(order[x]))):
                here = (F.col("formula") == text) & (F.col("ref_no") == k)
                a, b = a.when(here, linear[0]), b.when(here, linear[1])
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    now = one.withColumn("refs", F.map_from_entries("refs")).select(*KEY, "to_sheet", "to_coord", a.alias("a"), b.alias("b")).where(finite(F.col("a")) & finite(F.col("b")))
    now, before = materialized(now, "chains"), None
    while True:
        far = now.select(F.col("sheet_id").alias("to_sheet"), F.col("coord").alias("to_coord"), F.col("to_sheet").alias("s2"), F.col("to_coord").alias("c2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        on = F.col("s2").isNotNull()
        seen = Observation()
        step = now.join(far, ["to_sheet", "to_coord"], "left").select(
            *KEY, F.coalesce("s2", "to_sheet").alias("to_sheet"), F.coalesce("c2", "to_coord").alias("to_coord"),
            F.when(on, F.col("a") * F.col("a2")).otherwise(F.col("a")).alias("a"), F.when(on, F.col("a") * F.col("b2") + F.col("b")).otherwise(F.col("b")).alias("b"), on.alias("jumped"),
        ).observe(seen, F.coalesce(F.count_if("jumped"), F.lit(0)).alias("n"))
        now = materialized(step, "chains").drop("jumped")
        # What still jumps when no fewer do than before runs in a cycle.
        if not seen.get["n"] or seen.get["n"] == before:
            break
        before = seen.get["n"]
    ends = now.select(F.col("sheet_id").alias("to_sheet"), F.col("coord").alias("to_coord"))
    return materialized(now.join(ends, ["to_sheet", "to_coord"], "left_anti").where(finite(F.col("a")) & finite(F.col("b"))), "chains")


def evaluate(todo: DataFrame, edges: DataFrame, known: DataFrame, formulas: list[str]) -> DataFrame:
    """``(sheet_id, coord, value, status)`` for ``todo(sheet_id, coord, kind, formula)``, given other cells' ``known(.., value)``.

    Each round is one job: values that were found arrive at the cells that wait for them, and cells whose references are all there get theirs.
    status is ok, or cycle for cells that wait for each other, whose value is 0.
    """
    to = [F.col("sheet_id").alias("to_sheet"), F.col("coord").alias("to_coord")]
    gather = todo.select(*KEY, (F.col("kind") == "formula").alias("gather"))
    pending = todo.select(*to, F.lit(True).alias("waits"))
    values = known.select(*to, F.col("value").alias("v"))
    marked = edges.join(gather, KEY).join(pending, ["to_sheet", "to_coord"], "left").join(values, ["to_sheet", "to_coord"], "left")
    v = F.when(F.col("own"), F.lit(0.0)).otherwise(F.col("v"))
    marked = materialized(marked.select(*KEY, "ref_no", "gather", "to_sheet", "to_coord", v.alias("v"), (F.col("waits").isNotNull() & ~F.col("own")).alias("waits")), "marked")
    needed = marked.groupBy(*KEY).agg(F.count("*").alias("needed"))
    left = materialized(todo.select(*KEY, "kind", "formula").join(needed, KEY, "left").fillna(0, ["needed"]), "todo")
    waiting = marked.where("waits").drop("waits", "v")
    empty = [F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(None).cast("struct<ref_no:int,v:double>").alias("last"), F.array().cast("array<struct<ref_no:int,v:double>>").alias("refs")]
    partial, chains, round_ = _gathered(_arrivals(marked.where("not waits"))), None, 0
    done: list[DataFrame] = []
    while True:
        # Cells without references are ready at once; later only those that something arrived for can be.
        rows = left.join(partial, KEY, "inner" if round_ else "left").withColumn("ready", F.coalesce("n", F.lit(0)) == F.col("needed"))
        rows = _with_values(rows.withColumn("pairs", F.col("refs")).withColumn("refs", F.when(F.col("ready"), F.map_from_entries("refs"))), formulas)
        rows = rows.select(*KEY, "n", "total", "last", F.col("pairs").alias("refs"), "ready", "value")
        if chains is not None and done:
            found = chains.join(done[-1].select(*to, "value"), ["to_sheet", "to_coord"]).select(*KEY, *empty, F.lit(True).alias("ready"), (F.col("a") * F.col("value") + F.col("b")).alias("value"))
            rows = rows.union(found)
        seen = Observation()
        table = materialized(rows.observe(seen, F.coalesce(F.count_if("ready"), F.lit(0)).alias("n")), "values")
        if not seen.get["n"]:
            break
        done.append(table.where("ready").select(*KEY, "value"))
        state, round_ = table.where("not ready").select(*KEY, *_PARTIAL), round_ + 1
        if round_ in ROUNDS_TO_CHAINS:
            every = reduce(DataFrame.union, done)
            open_ = left.join(every, KEY, "left_anti").join(state, KEY, "left").fillna(0, ["n", "total"]).withColumn("refs", F.coalesce("refs", empty[3]))
            own = _chains(open_, waiting, formulas)
            if not own.isEmpty():
                chains = own if chains is None else chains.union(own)
                left, waiting = left.join(own, KEY, "left_anti"), waiting.join(own.select(*KEY), KEY, "left_anti")
                state = state.join(own.select(*KEY), KEY, "left_anti")
        new = waiting.join(done[-1].select(*to, F.col("value").alias("v")), ["to_sheet", "to_coord"])
        partial = _gathered(state.union(_arrivals(new)))
    computed = reduce(DataFrame.union, done) if done else left.select(*KEY, F.lit(0.0).alias("value")).limit(0)
    rest = todo.select(*KEY).join(computed, KEY, "left_anti").select(*KEY, F.lit(0.0).alias("value"), F.lit("cycle").alias("status"))
    return computed.withColumn("status", F.lit("ok")).union(rest)


def calculate(model: Model, dense: bool = False) -> Calculated:
    """All cells of the model with their values."""
    # Both are read many times; as files they keep the plans small.
    model = replace(model, records=materialized(model.records, "records"), cells=materialized(model.cells, "cells"))
    tree = hierarchy.closure(model.records)
    cells = materialized(resolve(model, enumerate_cells(model, dense, tree)), "cells")
    bound, formulas = bind(model, cells, tree)
    edges = materialized(bound, "edges")
    todo = cells.where("kind <> 'stored'").select(*KEY, "kind", "formula")
    known = cells.where("kind = 'stored'").select(*KEY, F.col("stored").alias("value"))
    got = evaluate(todo, edges, known, formulas)
    lost = edges.where("to_coord is null").select(*KEY).distinct().withColumn("lost", F.lit(True))
    values = cells.select(*KEY, "stored", "kind", "source").join(got, KEY, "left").join(lost, KEY, "left")
    status = F.when((F.col("status") == "ok") & F.col("lost"), "unresolved").otherwise(F.coalesce("status", F.lit("ok")))
    values = values.select(
        *KEY, F.coalesce("value", "stored").alias("value"), F.col("stored").alias("old"), "kind", "source", status.alias("status"), F.col("stored").isNull().alias("was_empty")
    )
    return Calculated(materialized(values, "calculated"), edges, todo)


def changes(result: Calculated) -> DataFrame:
    """``(sheet_id, coord, value_str)`` of computed cells whose value differs from the stored one."""
    rows = result.values.where("kind <> 'stored' and status = 'ok'")
    return rows.where(numbers.changed(F.col("old"), F.col("value"), F.col("was_empty"))).select(*KEY, numbers.as_text(F.col("value")).alias("value_str"))


def dirty(edges: DataFrame, changed: DataFrame, most: int | None = None) -> DataFrame | None:
    """Cells that depend on ``changed(sheet_id, coord)``, directly or through others: a frontier that grows until nothing is new.

    With ``most`` rounds given, nothing is returned if they don't reach the end.
    """
    back = edges.where("to_coord is not null").select(F.col("to_sheet"), F.col("to_coord"), *KEY)
    fronts = [materialized(changed.select(*KEY).distinct(), "front")]
    while True:
        seen = reduce(DataFrame.union, fronts)
        at = fronts[-1].select(F.col("sheet_id").alias("to_sheet"), F.col("coord").alias("to_coord"))
        count = Observation()
        step = back.join(at, ["to_sheet", "to_coord"], "left_semi").select(*KEY).distinct().join(seen, KEY, "left_anti")
        front = materialized(step.observe(count, F.count("*").alias("n")), "front")
        if not count.get["n"]:
            return seen
        fronts.append(front)
        if len(fronts) == most:
            return None


def update(result: Calculated, edits: DataFrame) -> Calculated:
    """The model after ``edits(sheet_id, coord, value)``: edited cells become manual, only what depends on them is evaluated.

    Where that reaches beyond ``DEEP`` steps, as along time, all computed cells are: composing chains costs less than walking them.
    """
    edits = edits.select(*KEY, F.col("value").alias("new")).dropDuplicates(KEY)
    touched = dirty(result.edges, edits, DEEP)
    todo = result.todo.join(edits, KEY, "left_anti")
    todo = todo if touched is None else todo.join(touched, KEY, "left_semi")
    known = result.values.join(todo.select(*KEY), KEY, "left_anti").join(edits, KEY, "full").select(*KEY, F.coalesce("new", "value").alias("value"))
    got = evaluate(todo, result.edges, known, _distinct_formulas(todo))
    merged = result.values.join(edits, KEY, "full").join(got.select(*KEY, F.col("value").alias("v"), F.col("status").alias("s")), KEY, "left")
    edited = F.col("new").isNotNull()
    merged = merged.select(
        *KEY, F.coalesce("new", "v", "value").alias("value"), F.when(edited, F.col("new")).otherwise(F.col("old")).alias("old"),
        F.when(edited, "stored").otherwise(F.col("kind")).alias("kind"), F.when(edited, "manual").otherwise(F.col("source")).alias("source"),
        F.when(edited, "ok").otherwise(F.coalesce("s", "status")).alias("status"), F.coalesce("was_empty", F.lit(True)).alias("was_empty"),
    )
    gone = edits.select(*KEY)
    return replace(result, values=materialized(merged, "calculated"), edges=materialized(result.edges.join(gone, KEY, "left_anti"), "edges"), todo=result.todo.join(gone, KEY, "left_anti"))
