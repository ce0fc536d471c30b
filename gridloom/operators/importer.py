"""Structure of imported worksheets: periods, totals, hierarchy, rules, checks.

A worksheet is long: ``grid(sheet_id, row, col, value, formula, indent, fill)``; all inference runs as joins and windows over
sheets, so many workbooks are read at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, periods, text
from . import hierarchy, reading

# Version labels and words for total columns.
VERSIONS = {"факт": "fact", "fact": "fact", "actual": "fact", "план": "plan", "plan": "plan", "budget": "plan", "прогноз": "forecast", "forecast": "forecast"}
TOTALS = r"(?iu)^(итого|всего|total|ytd|год|year)"


def period_columns(grid: DataFrame, rows: int = 20) -> DataFrame:
    """``(sheet_id, row, col, period_key)``: the header row of each sheet is the one of its first ``rows`` that names most periods."""
    year = F.when(F.trim("value").rlike(r"^(19|20)\d\d$"), F.trim("value"))
    top = grid.where(F.col("row") <= rows).withColumn("period_key", periods.from_header(F.col("value"))).withColumn("y", year)
    found = top.where("period_key is not null").groupBy("sheet_id", "row").agg(F.count_distinct("period_key").alias("n"))
    head = found.groupBy("sheet_id").agg(F.max_by("row", F.struct("n", (-F.col("row")).alias("r"))).alias("row"))
    return top.join(head, ["sheet_id", "row"]).where("period_key is not null").select("sheet_id", "row", "col", "period_key")


def month_counters(header: DataFrame, first_year: int) -> DataFrame:
    """Keys of columns headed ``N мес`` or ``month N``, counted on from January of ``first_year``."""
    n = F.regexp_extract(F.lower("value"), r"(?:^(\d+)\s*мес|^month\s*(\d+))", 0)
    k = F.regexp_extract(n, r"(\d+)", 1).try_cast("int") - 1
    key = F.format_string("%04d-%02d", (F.lit(first_year) + F.floor(k / 12)).cast("int"), (k % 12 + 1).cast("int"))
    return header.where(n != "").select("sheet_id", "col", key.alias("period_key"))


def inherited_years(header: DataFrame) -> DataFrame:
    """Adds ``year`` to ``header(sheet_id, col, value)``: the nearest year in a column to the left or the own one."""
    own = F.regexp_extract("value", r"((?:19|20)\d\d)", 1)
    rows = header.withColumn("_y", F.when(own != "", own.cast("int")))
    return rows.withColumn("year", reading.carried(rows, ["sheet_id"], "col", "_y")).drop("_y")


def version_row(grid: DataFrame) -> DataFrame:
    """``(sheet_id, row, col, version)`` from the row with most version labels."""
    word = F.create_map(*[F.lit(x) for kv in VERSIONS.items() for x in kv])
    rows = grid.withColumn("version", F.get(F.array(word[F.lower(F.trim("value"))]), F.lit(0))).where("version is not null")
    best = rows.groupBy("sheet_id", "row").count().groupBy("sheet_id").agg(F.max_by("row", F.struct("count", (-F.col("row")).alias("r"))).alias("row"))
    return rows.join(best, ["sheet_id", "row"]).select("sheet_id", "row", "col", "version")


def leaf_columns(columns: DataFrame) -> DataFrame:
    """``columns(sheet_id, col, period_key)`` with ``is_total`` and, for leaves, ``leaf_no`` from 0."""
    rank = periods.rank(F.col("period_key"))
    least = F.min(rank).over(Window.partitionBy("sheet_id", F.substring("period_key", 1, 4)))
    rows = columns.withColumn("is_total", rank > least)
    n = F.row_number().over(Window.partitionBy("sheet_id", "is_total").orderBy("col")) - 1
    return rows.withColumn("leaf_no", F.when(~F.col("is_total"), n))


def period_type(columns: DataFrame) -> DataFrame:
    """Finest level of each sheet's periods."""
    has = lambda k: F.bool_or(periods.level(F.col("period_key")) == k)
    return columns.groupBy("sheet_id").agg(F.when(has("M"), "M").when(has("Q"), "Q").when(has("H"), "H").otherwise("Y").alias("level"))


def tree_from_rows(labels: DataFrame) -> DataFrame:
    """Records from ``labels(sheet_id, row, name, indent)``: parents by indentation, equal siblings numbered."""
    rows = hierarchy.parents_by_indent(labels.withColumn("pos", F.col("row")))
    base = rows.select(F.col("sheet_id").alias("analytic_id"), F.xxhash64("sheet_id", "row").alias("record_id"),
        F.when(F.col("parent_pos").isNotNull(), F.xxhash64("sheet_id", F.col("parent_pos").cast(dict(rows.dtypes)["row"]))).alias("parent_id"),
        F.col("row").alias("sort_order"), F.trim("name").alias("name"), F.lit(None).cast("string").alias("period_key"), F.col("row").cast("int").alias("excel_row"))
    w = Window.partitionBy("analytic_id", "parent_id", F.lower("name")).orderBy("sort_order")
    n = F.row_number().over(w)
    return base.withColumn("name", F.when(n > 1, F.concat("name", F.lit(" #"), n.cast("string"))).otherwise(F.col("name")))


def label_levels(labels: DataFrame, columns: list[str]) -> DataFrame:
    """Several label columns as one hierarchy: a row for each new value, its column's number being the indentation."""
    order = Window.partitionBy("sheet_id").orderBy("row")
    out, outer = [], F.lit(False)
    for k, c in enumerate(columns):
        new = F.col(c).isNotNull() & (~F.col(c).eqNullSafe(F.lag(c).over(order)) | outer)
        out.append(F.struct(F.lit(k).alias("indent"), F.when(new, F.trim(c)).alias("name")))
        outer = outer | new
    rows = labels.withColumn("_l", F.array(*out)).select("sheet_id", "row", F.explode(F.filter("_l", lambda x: x["name"].isNotNull())).alias("x"))
    n = F.row_number().over(Window.partitionBy("sheet_id").orderBy("row", "x.indent"))
    return rows.select("sheet_id", n.alias("row"), F.col("row").alias("source_row"), "x.indent", "x.name")


def classified(labels: DataFrame, patterns: list[tuple[str, list[str], str, float]]) -> DataFrame:
    """Adds ``action``: that of the most confident of ``patterns(kind, values, action, confidence)`` that matches the name, else ``indicator``."""
    out: Column | None = None
    for kind, values, action, _ in sorted(patterns, key=lambda p: -p[3]):
        test = text.matches(F.col("name"), kind, values)
        out = F.when(test, action) if out is None else out.when(test, action)
    return labels.withColumn("action", F.lit("indicator") if out is None else out.otherwise("indicator"))


def consolidation_of(formula: Column, total_col: Column, columns: Column | None = None) -> Column:
    """What a total column's formula does: SUM, AVERAGE, LAST, RATIO (of two cells in its own column) or null."""
    f = F.upper(F.regexp_replace(formula, r"[\s$]", ""))
    same = F.concat(F.lit("^=("), total_col, F.lit(r"\d+)/("), total_col, F.lit(r"\d+)$"))
    return (
        F.when(f.rlike(r"^=SUM\([A-Z]+\d+[:;,][A-Z0-9:;,]*\)$") | f.rlike(r"^=[A-Z]+\d+(\+[A-Z]+\d+)+$"), "SUM")
        .when(f.rlike(r"^=AVERAGE\(") | f.rlike(r"^=\(?[A-Z]+\d+(\+[A-Z]+\d+)+\)?/\d+$") | f.rlike(r"^=SUM\([A-Z0-9:]+\)/\d+$"), "AVERAGE")
        .when(F.regexp_like(f, same), "RATIO")
        .when(f.rlike(r"^=[A-Z]+\d+$"), "LAST")
    )


def is_external(formula: Column) -> Column:
    """Whether a formula reads another workbook."""
    return formula.rlike(r"\[[^\]]*\.xls[xmb]?\]|\[\d+\]")


def _column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


_CELL = re.compile(r"(?:(?:'([^']+)'|([A-Za-zА-Яа-я_][\w.]*))!)?\$?([A-Z]{1,3})\$?(\d+)(?::\$?([A-Z]{1,3})\$?(\d+))?")


def translated_formula(formula: str, col: int, names: dict[int, str], sheets: dict[str, dict[int, str]] | None = None, values: dict[tuple[int, int], float] | None = None) -> str:
    """A spreadsheet formula in the cell language; columns left and right of ``col`` become periods back and forward.

    ``names`` gives the indicator of each row, ``sheets`` those of other sheets. Cells of rows without a name are replaced by
    their value. Percent literals become numbers; vertical ranges become lists of the rows that have names.
    """
    sheets, values = sheets or {}, values or {}

    def one(sheet: str | None, letters: str, row: int) -> str:
        own = sheets.get(sheet, {}) if sheet else names
        at = _column_number(letters)
        if row not in own:
            return repr(values.get((row, at), 0.0))
        ref = f"[{sheet}::{own[row]}]" if sheet else f"[{own[row]}]"
        off = at - col
        if not off:
            return ref
        word = "предыдущий" if off == -1 else f"назад({-off})" if off < 0 else f"вперед({off})"
        return f'{ref}(периоды="{word}")'

    def put(m: re.Match) -> str:
        sheet = m[1] or m[2]
        if not m[5]:
            return one(sheet, m[3], int(m[4]))
        own = sheets.get(sheet, {}) if sheet else names
        cols = range(_column_number(m[3]), _column_number(m[5]) + 1)
        cells = [(c, r) for r in range(int(m[4]), int(m[6]) + 1) if r in own for c in cols]
        letters = lambda c: (letters((c - 1) // 26) if c > 26 else "") + chr(65 + (c - 1) % 26)
        return ", ".join(one(sheet, letters(c), r) for c, r in cells) or "0"

    body = re.sub(r"(\d+(?:[.,]\d+)?)%", lambda m: repr(float(m[1].replace(",", ".")) / 100), formula.strip().lstrip("="))
    return _CELL.sub(put, body).replace("<>", "!=")


def first_formulas(cells: DataFrame) -> DataFrame:
    """First and second formula of each row, by leaf column: the one of the first period may differ from the others."""
    n = F.row_number().over(Window.partitionBy("sheet_id", "row").orderBy("col"))
    rows = cells.where("formula is not null").withColumn("n", n).where("n <= 2")
    return rows.groupBy("sheet_id", "row").agg(F.max(F.when(F.col("n") == 1, F.col("formula"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("formula"))).alias("then"))


def cell_rule(formula: Column, fill: Column, has_children: Column) -> Column:
    """manual, formula or sum_children for an imported cell: inputs (yellow, beige) without a formula and formulas of other workbooks keep their value."""
    f = F.trim(F.coalesce(formula, F.lit("")))
    return F.when((text.is_input_fill(fill) & ~f.startswith("=")) | is_external(f), "manual").when(f.startswith("="), "formula").when(has_children, "sum_children").otherwise("manual")


def first_of_each_row(chunks: DataFrame) -> DataFrame:
    """Rows of overlapping chunks merged: the first chunk that has a row wins."""
    n = F.row_number().over(Window.partitionBy("sheet_id", "row").orderBy("chunk"))
    return chunks.withColumn("_n", n).where("_n = 1").drop("_n")


def verified(imported: DataFrame, source: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``(sheet_id, cells, matched, rate)`` of imported against source values."""
    got = reading.compared(imported, source, ["sheet_id", "row", "col"], tolerance)
    return got.groupBy("sheet_id").agg(F.count("*").alias("cells"), F.count_if("ok").alias("matched"), numbers.rounded(F.avg(F.col("ok").cast("double")), 4).alias("rate"))
