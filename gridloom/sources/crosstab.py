"""Crosstabs and tab-separated blocks to and from cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import hierarchy


def exported(cells: DataFrame, rows: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """One row for each of ``rows`` (records) in tree order, its name indented, one column for each (record id, title) of ``columns``.

    ``cells(row_id, col_id, value_str)``.
    """
    tree = hierarchy.in_tree_order(rows).select(F.col("record_id").alias("row_id"), F.concat(F.repeat(F.lit("  "), F.col("depth")), "name").alias("name"), "tree_path")
    wide = cells.groupBy("row_id").pivot("col_id", [c for c, _ in columns]).agg(F.first("value_str"))
    wide = wide.withColumnsRenamed({str(c): t for c, t in columns})
    return tree.join(wide, "row_id", "left").orderBy("tree_path").drop("tree_path", "row_id")


def dimension(records: DataFrame) -> DataFrame:
    """Records in tree order with ``shown``, their name indented by two spaces a level, and their place in ``tree_path``."""
    return hierarchy.in_tree_order(records).withColumn("shown", F.concat(F.repeat(F.lit("  "), F.col("depth")), "name"))


def imported(table: DataFrame, rows: DataFrame, columns: dict[str, int], label: str = "name") -> DataFrame:
    """``(row_id, col_id, value_str)`` of a crosstab; rows are found by their trimmed, lower-cased name, the first by order if several have it."""
    long = table.unpivot([label], list(columns), "title", "value_str").where("value_str is not null")
    named = rows.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min_by("record_id", F.struct("sort_order", "record_id")).alias("row_id"))
    ids = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    return long.withColumn("k", F.lower(F.trim(label))).join(named, "k").select("row_id", ids[F.col("title")].cast("long").alias("col_id"), "value_str")


def pasted(blocks: DataFrame) -> DataFrame:
    """``(block_id, row, col, value)`` of tab-separated ``blocks(block_id, text)``, places from 0."""
    lines = blocks.select("block_id", F.posexplode(F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n")).alias("row", "line"))
    cells = lines.select("block_id", "row", F.posexplode(F.split("line", "\t")).alias("col", "x"))
    return cells.select("block_id", "row", "col", numbers.parsed_local(F.col("x")).alias("value"))


def copied(cells: DataFrame) -> DataFrame:
    """The reverse: one text for each block."""
    ordered = lambda by, x: F.transform(F.sort_array(F.collect_list(F.struct(by, x))), lambda s: s[x])
    lines = cells.withColumn("t", F.coalesce(numbers.as_text(F.col("value")), F.lit(""))).groupBy("block_id", "row").agg(F.array_join(ordered("col", "t"), "\t").alias("line"))
    return lines.groupBy("block_id").agg(F.array_join(ordered("row", "line"), "\n").alias("text"))


def titles(sheets: DataFrame, most: int = 31) -> DataFrame:
    """Unique worksheet titles of at most ``most`` characters."""
    short = sheets.withColumn("title", F.substring("name", 1, most))
    n = F.row_number().over(Window.partitionBy(F.lower("title")).orderBy("sheet_id"))
    tail = F.concat(F.lit("~"), n.cast("string"))
    return short.withColumn("_n", n).withColumn("title", F.when(F.col("_n") > 1, F.concat(F.substring(F.col("title"), F.lit(1), F.lit(most) - F.length(tail)), tail)).otherwise(F.col("title"))).drop("_n")
