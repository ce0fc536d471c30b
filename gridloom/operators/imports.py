"""From worksheets to a model: header, labels, tree, its repair, rules, cells and checks, for all sheets at once.

``grid(sheet_id, row, col, value, formula, indent, fill, bold)`` holds the cells of any number of sheets; a sheet's outline levels may
stand in ``outline``. Rows of a sheet become indicators, columns under a period become periods. A tree is a table
``(sheet_id, row, parent_row, ...)``, parents being rows above, so every step is a window by sheet or a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, periods, text
from ..session import materialized
from . import hierarchy, importer
from .calc import Model

# Words that make a row a group by its end or its beginning.
GROUP_END = r"(?iu)(в\s+т\.?\s*ч\.?\s*:?|в\s+том\s+числе\s*:?|включая\s*:?)\s*$"
GROUP_START = r"(?iu)^(итого|всего|общее\s|общий\s|общая\s|суммарн|сумма\s)"


def is_group_name(name: Column) -> Column:
    return name.rlike(GROUP_END) | name.rlike(GROUP_START)


def period_range(header: DataFrame) -> DataFrame:
    """``(sheet_id, start, end)`` from ``header(sheet_id, period_key)``: the first and the last day that a sheet's periods hold."""
    key = F.col("period_key")
    return header.groupBy("sheet_id").agg(F.min(periods.start(key)).alias("start"), F.max(periods.end(key)).alias("end"))


def label_column(grid: DataFrame, header: DataFrame) -> DataFrame:
    """``(sheet_id, label_col)``: of the columns left of the periods the one with most texts of two letters or more, ties to the left."""
    first = header.groupBy("sheet_id").agg(F.min("col").alias("first"), F.max("row").alias("head"))
    left = grid.join(first, "sheet_id").where("col < first and row > head")
    words = left.where(numbers.parsed(F.col("value")).isNull() & (F.length(F.trim("value")) > 1)).groupBy("sheet_id", "col").agg(F.count("*").alias("n"))
    return words.groupBy("sheet_id").agg(F.max_by("col", F.struct("n", -F.col("col"))).alias("label_col"))


def label_rows(grid: DataFrame, header: DataFrame) -> DataFrame:
    """``(sheet_id, row, name, unit, indent, outline, bold, has_data, has_formula)`` of the rows below a sheet's header that have a label."""
    column = label_column(grid, header)
    head = header.groupBy("sheet_id").agg(F.max("row").alias("head"))
    data = grid.join(header.select("sheet_id", "col"), ["sheet_id", "col"], "left_semi").groupBy("sheet_id", "row").agg(F.bool_or(F.col("value").isNotNull()).alias("d"), F.bool_or(F.coalesce(F.startswith("formula", F.lit("=")), F.lit(False))).alias("f"))
    own = grid.join(column, "sheet_id").join(head, "sheet_id").where("row > head")
    units = own.where("col = label_col + 1").join(header.select("sheet_id", "col"), ["sheet_id", "col"], "left_anti").select("sheet_id", "row", F.trim("value").alias("unit"))
    rows = own.where("col = label_col and trim(value) <> ''").join(units, ["sheet_id", "row"], "left").join(data, ["sheet_id", "row"], "left")
    outline = F.col("outline") if "outline" in grid.columns else F.lit(0)
    level = F.coalesce(outline, F.lit(0))
    indent = F.coalesce("indent", F.lit(0))
    return rows.select(
        "sheet_id", "row", F.trim("value").alias("name"), F.coalesce("unit", F.lit("")).alias("unit"), F.when(indent == 0, level).otherwise(indent).alias("indent"), level.alias("outline"),
        F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("d", F.lit(False)).alias("has_data"), F.coalesce("f", F.lit(False)).alias("has_formula"),
    )


def grouped_rows(labels: DataFrame) -> DataFrame:
    """Adds ``is_group`` and ``parent_row``: group headers are rows named so, or bold ones without data, and hold the rows below of the same indentation up to the next bold one."""
    group = is_group_name(F.col("name")) | (F.col("bold") & ~F.col("has_data"))
    level = (F.col("indent") * 2 + F.when(group | F.col("bold"), 0).otherwise(1)).cast("int")
    rows = labels.select(*labels.columns, group.alias("is_group"), F.col("row").alias("pos"), F.col("indent").alias("_own"))
    found = hierarchy.parents_by_indent(rows.withColumn("indent", level), 32)
    return found.withColumn("indent", F.col("_own")).withColumnRenamed("parent_pos", "parent_row").drop("pos", "_own")


def lifted(rows: DataFrame, out: Column) -> DataFrame:
    """Rows whose parents ``out`` holds for get the nearest ancestor that it doesn't hold for, or none."""
    key = F.struct("sheet_id", F.col("row").cast("long").alias("row"))
    parent = F.when(F.col("parent_row").isNotNull(), F.struct("sheet_id", F.col("parent_row").cast("long").alias("row")))
    tree = hierarchy.closure(rows.select(key.alias("record_id"), parent.alias("parent_id")))
    kept = rows.where(~F.coalesce(out, F.lit(False))).select(key.alias("anc"))
    best = tree.where("depth > 0").join(kept, "anc").groupBy("desc").agg(F.min_by("anc.row", "depth").alias("p"))
    best = best.select(F.col("desc.sheet_id").alias("sheet_id"), F.col("desc.row").alias("row"), F.col("p").cast(dict(rows.dtypes)["parent_row"]).alias("_p"))
    return rows.join(best, ["sheet_id", "row"], "left").withColumn("parent_row", F.col("_p")).drop("_p")


def repaired(rows: DataFrame) -> DataFrame:
    """Mends a given tree ``(sheet_id, row, parent_row, name, indent, outline)`` in four steps.

    Groups with a child that isn't indented more than they are lose their children; rows without a parent go below the row above
    that is indented less; what is left without one goes below a group header by name above it, up to the next header;
    rows with an outline level are no groups, so their children rise.
    """
    kids = rows.where("parent_row is not null").select("sheet_id", F.col("parent_row").alias("row"), F.col("indent").alias("k")).groupBy("sheet_id", "row").agg(F.min("k").alias("least"))
    marked = rows.join(kids, ["sheet_id", "row"], "left")
    flat = lifted(marked, F.col("least") <= F.col("indent")).drop("least")
    by_indent = hierarchy.parents_by_indent(flat.withColumn("pos", F.col("row")), 32).withColumn("parent_row", F.coalesce("parent_row", "parent_pos")).drop("pos", "parent_pos")
    has_kids = by_indent.where("parent_row is not null").select("sheet_id", F.col("parent_row").alias("row")).distinct().withColumn("_k", F.lit(True))
    both = by_indent.join(has_kids, ["sheet_id", "row"], "left")
    top = F.col("parent_row").isNull()
    above = Window.partitionBy("sheet_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    # The last row at the top that begins a group; one that has children already, or a header, ends what stands before it.
    starts = F.when(top & (F.col("_k") | is_group_name(F.col("name"))), F.struct(F.col("row").alias("r"), F.col("_k").isNull().alias("open")))
    last = F.last(starts, ignorenulls=True).over(above)
    adopt = top & F.col("_k").isNull() & ~is_group_name(F.col("name")) & last.getField("open")
    named = both.withColumn("_l", F.when(adopt, last.getField("r"))).withColumn("parent_row", F.coalesce("parent_row", "_l")).drop("_l", "_k")
    return lifted(named, F.col("outline") > 0)


def without_empty_parents(rows: DataFrame) -> DataFrame:
    """Rows below a parent without data in any period column rise; the parent stays as a row of its own."""
    return lifted(rows, ~F.col("has_data"))


def by_formatting(labels: DataFrame) -> DataFrame:
    """Adds ``parent_row`` from fonts alone: bold rows are sections, others belong to the section above."""
    level = F.when(F.col("bold"), 0).otherwise(1) + F.col("indent")
    rows = labels.select(*labels.columns, F.col("row").alias("pos"), F.col("indent").alias("_own")).withColumn("indent", level.cast("int"))
    return hierarchy.parents_by_indent(rows, 32).withColumn("indent", F.col("_own")).withColumnRenamed("parent_pos", "parent_row").drop("pos", "_own")


def checked_names(rows: DataFrame) -> DataFrame:
    """``name`` of ``rows(name, a, b, c)`` replaced by the joined label cells unless it is one of the ways to write them."""
    plain = lambda c: text.normalized(c)
    a, b, c = (F.coalesce(F.trim(x), F.lit("")) for x in ("a", "b", "c"))
    put = lambda *x: F.array_join(F.filter(F.array(*x), lambda p: p != ""), ". ")
    ways = F.transform(F.array(c, put(b, c), put(a, b, c), put(a, c), put(a, b), b, a), plain)
    own = F.regexp_replace(plain(F.col("name")), r" #[2-5]$", "")
    fits = F.array_contains(ways, own) | F.array_contains(ways, plain(F.col("name")))
    return rows.withColumn("name", F.when(fits | (put(a, b, c) == ""), F.col("name")).otherwise(put(a, b, c)))


def with_lost_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows(sheet_id, row, name, parent_row)`` and the labelled rows with data that they lack, each beside the row above it."""
    lost = labels.where("has_data").join(rows, ["sheet_id", "row"], "left_anti").select("sheet_id", "row", "name", F.lit(True).alias("_new"))
    both = rows.select("sheet_id", "row", "name", "parent_row", F.lit(False).alias("_new")).unionByName(lost, allowMissingColumns=True)
    above = Window.partitionBy("sheet_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(~F.col("_new"), F.struct("parent_row")), ignorenulls=True).over(above)
    return both.withColumn("parent_row", F.when(F.col("_new"), near.getField("parent_row")).otherwise(F.col("parent_row"))).drop("_new")


def tree_counts(rows: DataFrame) -> DataFrame:
    """Counts of a tree by sheet: ``(sheet_id, rows, roots, groups)``."""
    groups = rows.where("parent_row is not null").groupBy("sheet_id").agg(F.count_distinct("parent_row").alias("groups"))
    return rows.groupBy("sheet_id").agg(F.count("*").alias("rows"), F.count_if(F.col("parent_row").isNull()).alias("roots")).join(groups, "sheet_id", "left").fillna(0, ["groups"])


def total_columns(grid: DataFrame, header: DataFrame, rows: int = 6) -> DataFrame:
    """``(sheet_id, col, kind)``: columns behind the first period, without one themselves, whose first ``rows`` rows name a year, a quarter or a total; kind is year or quarter."""
    t = F.trim("value")
    kind = F.when(t.rlike(r"^(199\d|20\d\d|2100)$"), "year").when(t.rlike(r"(?iu)\bq[1-4]\b|квартал|кв\."), "quarter").when(t.rlike(importer.TOTALS), "year")
    top = grid.where(F.col("row") <= rows).join(header.select("sheet_id", "col"), ["sheet_id", "col"], "left_anti")
    top = top.join(header.groupBy("sheet_id").agg(F.min("col").alias("_first")), "sheet_id").where("col > _first").drop("_first")
    return top.withColumn("kind", kind).where("kind is not null").groupBy("sheet_id", "col").agg(F.min_by("kind", "row").alias("kind"))


def column_letters(col: Column) -> Column:
    """A, B, ..., Z, AA, ..., ZZ of a column number."""
    letter = lambda k: F.chr(k + 65)
    return F.when(col <= 26, letter(col - 1)).otherwise(F.concat(letter(F.floor((col - 1) / 26) - 1), letter(F.pmod(col - 1, F.lit(26)))))


def consolidation_rules(grid: DataFrame, totals: DataFrame, names: DataFrame) -> DataFrame:
    """``(sheet_id, row, formula)``: what the first year column (else the first quarter column) of a sheet does, where it is more than a sum.

    ``names(sheet_id, row, name)``; a ratio of two cells becomes ``[numerator]/[denominator]``.
    """
    best = totals.groupBy("sheet_id").agg(F.min(F.struct((F.col("kind") != "year").alias("k"), "col")).alias("b")).select("sheet_id", F.col("b.col").alias("col"))
    cells = grid.where("formula like '=%'").join(best, ["sheet_id", "col"]).join(names.select("sheet_id", "row"), ["sheet_id", "row"], "left_semi")
    kind = importer.consolidation_of(F.col("formula"), column_letters(F.col("col")))
    pair = F.regexp_extract_all(F.regexp_replace("formula", r"\$", ""), F.lit(r"[A-Za-z]+(\d+)"), F.lit(1))
    rows = cells.withColumns({"kind": kind, "p": pair}).where("kind <> 'SUM'")
    name = lambda k, c: names.select("sheet_id", F.col("row").cast("string").alias(k), F.col("name").alias(c))
    rows = rows.withColumns({"n": F.get("p", F.lit(0)), "d": F.get("p", F.lit(1))}).join(name("n", "top"), ["sheet_id", "n"], "left").join(name("d", "low"), ["sheet_id", "d"], "left")
    formula = F.when(F.col("kind") == "RATIO", F.concat(F.lit("["), "top", F.lit("]/["), "low", F.lit("]"))).otherwise(F.col("kind"))
    return rows.select("sheet_id", "row", formula.alias("formula")).where("formula is not null")


_TEXTS = "sheet_id string, row int, col int, text string"


def translated(cells: DataFrame, names: DataFrame) -> DataFrame:
    """``(sheet_id, row, col, text)``: the formulas of ``cells(sheet_id, row, col, value, formula)`` in the cell language, sheet by sheet.

    A sheet's names, and the values of its rows without one, meet its formulas in one group, which a worksheet's size bounds.
    """

    def run(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(rows.line, rows.name_, strict=True))
        values = {(r, c): float(v) for r, c, v in zip(own.row, own.col, own.number, strict=True) if v == v and r not in known}
        asked = own[own.formula.notna()]
        found = [importer.translated_formula(f, int(c), known, None, values) for f, c in zip(asked.formula, asked.col, strict=True)]
        return asked[["sheet_id", "row", "col"]].assign(text=found)

    plain = F.when(F.col("formula").startswith("=") & ~importer.is_external(F.col("formula")), F.col("formula"))
    cells = cells.select("sheet_id", "row", "col", numbers.parsed_local(F.col("value")).alias("number"), plain.alias("formula"))
    rows = names.select(F.col("sheet_id").alias("sheet"), F.col("row").alias("line"), F.col("name").alias("name_"))
    return cells.groupBy("sheet_id").cogroup(rows.groupBy("sheet")).applyInPandas(run, _TEXTS)


def imported_cells(grid: DataFrame, header: DataFrame, tree: DataFrame) -> DataFrame:
    """``(sheet_id, row, col, period_key, value_str, rule, formula)`` of the cells of indicators under periods that hold numbers.

    Inputs and formulas of other workbooks are manual, formulas are translated, groups without a formula are sums of their children, and a first period's formula
    that looks back keeps its value as an opening balance.
    """
    first = header.groupBy("sheet_id").agg(F.min("col").alias("first"))
    parents = tree.where("parent_row is not null").select("sheet_id", F.col("parent_row").alias("row")).distinct().withColumn("inner", F.lit(True))
    cells = grid.join(header.select("sheet_id", "col", "period_key"), ["sheet_id", "col"]).join(tree.select("sheet_id", "row"), ["sheet_id", "row"]).join(parents, ["sheet_id", "row"], "left")
    cells = cells.withColumn("number", numbers.parsed_local(F.col("value"))).where("number is not null").join(first, "sheet_id")
    texts = translated(grid.select("sheet_id", "row", "col", "value", "formula"), tree.select("sheet_id", "row", "name"))
    cells = cells.join(texts, ["sheet_id", "row", "col"], "left")
    looks_back = F.col("text").rlike("предыдущий|назад") & (F.col("col") == F.col("first")) & (F.col("number") != 0)
    rule = F.when(F.col("text").isNotNull() & ~F.coalesce(looks_back, F.lit(False)), "formula").when(F.col("inner") & F.col("text").isNull(), "sum_children").otherwise("manual")
    return cells.withColumn("rule", rule).select("sheet_id", "row", "col", "period_key", numbers.as_text(F.col("number")).alias("value_str"), "rule", F.when(F.col("rule") == "formula", F.col("text")).alias("formula"))


def analysis(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header and tree of every sheet that has both, told by rules alone: ``(header, tree)``. Columns that a finer one of their year makes totals are left out."""
    header = importer.leaf_columns(importer.period_columns(grid)).where("not is_total").select("sheet_id", "row", "col", "period_key")
    header = materialized(header, "header")
    return header, materialized(grouped_rows(label_rows(grid, header)), "tree")


def _period_id(key: Column) -> Column:
    return F.xxhash64(F.lit("per"), key)


def _row_id(sheet: Column, row: Column) -> Column:
    return F.xxhash64(F.lit("row"), sheet, row.cast("long"))


def imported_model(grid: DataFrame) -> Model:
    """A model from worksheets: one period axis for all, an axis of indicators for each sheet.

    Record ids are hashes of the period key, or of sheet and row, so an import that is repeated gives the same ids.
    """
    header, tree = analysis(grid)
    per, row = _period_id, _row_id
    keys = hierarchy.with_period_ancestors(header.select("period_key").distinct(), ("M", "Q", "Y"))
    key, no_text, no_int = F.col("period_key"), F.lit(None).cast("string"), F.lit(None).cast("int")
    parent = periods.parent_key(key, ("M", "Q", "Y"))
    known = keys.select(F.col("period_key").alias("_p"))
    times = keys.withColumn("_p", parent).join(known, "_p", "left").select(
        per(key).alias("record_id"), F.lit("per").alias("analytic_id"), F.when(F.col("_p").isNotNull(), per(F.col("_p"))).alias("parent_id"),
        F.datediff(periods.start(key), F.lit("1900-01-01").cast("date")).alias("sort_order"), periods.name(key).alias("name"), "period_key", no_int.alias("excel_row"))
    ind = F.concat(F.lit("ind:"), "sheet_id")
    rows = tree.select(row(F.col("sheet_id"), F.col("row")).alias("record_id"), ind.alias("analytic_id"), F.when(F.col("parent_row").isNotNull(), row(F.col("sheet_id"), F.col("parent_row"))).alias("parent_id"),
        F.col("row").cast("int").alias("sort_order"), "name", no_text.alias("period_key"), F.col("row").cast("int").alias("excel_row"))
    rows = hierarchy.numbered_siblings(rows.withColumn("_p", F.col("parent_id")).withColumn("parent_id", F.coalesce("parent_id", F.xxhash64("analytic_id")))).withColumn("parent_id", F.col("_p")).drop("_p")
    cells = imported_cells(grid, header, tree).select("sheet_id", F.array(per(key), row(F.col("sheet_id"), F.col("row"))).alias("coord"), "value_str", "rule", "formula")
    rules = consolidation_rules(grid, total_columns(grid, header), tree.select("sheet_id", "row", "name"))
    rules = rules.select(F.concat_ws(":", F.lit("import"), "sheet_id", F.col("row").cast("string")).alias("rule_id"), "sheet_id", row(F.col("sheet_id"), F.col("row")).alias("indicator_id"),
        F.lit("consolidation").alias("kind"), F.lit(None).cast("map<string,string>").alias("scope"), F.lit(0).alias("priority"), "formula")
    sheets = tree.select("sheet_id").distinct()
    axis = lambda i, analytic, name, main, time: F.struct(F.lit(i).alias("axis_idx"), analytic.alias("analytic_id"), F.lit(name).alias("name"), F.lit(main).alias("is_main"), F.lit(time).alias("is_period"))
    axes = sheets.select("sheet_id", F.explode(F.array(axis(0, F.lit("per"), "периоды", False, True), axis(1, ind, "показатели", True, False))).alias("x")).select("sheet_id", "x.*")
    return Model(sheets.select("sheet_id", F.col("sheet_id").alias("name"), no_text.alias("excel_code")), axes, times.unionByName(rows), cells, rules)


def shown_values(grid: DataFrame) -> DataFrame:
    """``(sheet_id, row, col, value)``: the numbers that worksheets show, row and column being the ids that ``imported_model`` gives indicator and period."""
    header, tree = analysis(grid)
    cells = grid.join(header.select("sheet_id", "col", "period_key"), ["sheet_id", "col"]).join(tree.select("sheet_id", "row"), ["sheet_id", "row"])
    value = numbers.parsed_local(F.col("value"))
    return cells.select("sheet_id", _period_id(F.col("period_key")).alias("row"), _row_id(F.col("sheet_id"), F.col("row")).alias("col"), value.alias("value")).where("value is not null")


def not_imported(grid: DataFrame, model: Model) -> DataFrame:
    """Sheets of the workbooks that the model lacks."""
    return grid.select("sheet_id").distinct().join(model.sheets.select("sheet_id"), "sheet_id", "left_anti")


def known_patterns(patterns: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The pattern base after a session: ``confirmed(pattern_key, pattern_type, match_rule, action, confidence)`` replace patterns of their keys, others are added.

    Ordered use is by confidence, see ``importer.classified``; ``source`` tells confirmed patterns from those that came with the base.
    """
    columns = ["pattern_key", "pattern_type", "match_rule", "action", "confidence"]
    old = patterns.join(confirmed, "pattern_key", "left_anti").select(*columns, "source")
    return old.unionByName(confirmed.select(*columns, F.lit("user_confirmed").alias("source")))


def chunked(labels: DataFrame, most: int = 120, overlap: int = 10) -> DataFrame:
    """Rows of long sheets with the number of each chunk of ``most`` rows that they are in; neighbours share ``overlap`` rows."""
    n = F.row_number().over(Window.partitionBy("sheet_id").orderBy("row")) - 1
    step = most - overlap
    first = F.greatest(F.floor((F.col("n") - most) / step) + 1, F.lit(0))
    return labels.withColumn("n", n).withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col("n") / step)))).drop("n")
