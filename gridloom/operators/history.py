"""Change history: saving with a log, latest and top entries, undo.

Entries have a ``seq`` that orders them, so several in one second are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized


def numbered(rows: DataFrame, order: list[str], column: str, first: int = 1) -> DataFrame:
    """Adds consecutive numbers in an order: rows are range-partitioned, numbered within partitions, and the partitions' sizes are added up."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialized(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a partition
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(column, (F.col("_before") + F.col("_own") + F.lit(first - 1)).cast("long")).drop("_part", "_own", "_before")


def saved(cells: DataFrame, edits: DataFrame, keys: list[str], next_seq: int) -> tuple[DataFrame, DataFrame]:
    """``cells(keys, value_str, rule)`` after ``edits(keys, value_str, user_id, ts)``, and the new history rows.

    Of several edits of a cell the last one by ts counts; a row is logged where the value differs.
    """
    last = edits.groupBy(*keys).agg(F.max_by(F.struct("value_str", "user_id", "ts"), F.struct("ts", "value_str")).alias("e"))
    both = cells.join(last, keys, "full")
    differs = F.col("e").isNotNull() & ~F.col("e.value_str").eqNullSafe(F.col("value_str"))
    new = both.withColumns({"old_value": F.col("value_str"), "_d": differs})
    log = new.where("_d").select(*keys, F.col("e.user_id").alias("user_id"), "old_value", F.col("e.value_str").alias("new_value"), F.col("e.ts").alias("created_at"))
    log = numbered(log, ["created_at", *keys], "seq", next_seq)
    done = new.select(*keys, F.when(F.col("_d"), F.col("e.value_str")).otherwise(F.col("value_str")).alias("value_str"), F.when(F.col("_d"), "manual").otherwise(F.col("rule")).alias("rule"))
    return done, log


def newest(history: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest entries (a report's length)."""
    return history.orderBy(F.desc("created_at"), F.desc("seq")).limit(n)


def latest(history: DataFrame, by: list[str], value: str = "new_value") -> DataFrame:
    return history.groupBy(*by).agg(F.max_by(value, F.struct("created_at", "seq")).alias("value"))


def undone(history: DataFrame, seq: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Going back to before entry ``seq``: the value that each cell had then, and the history that is left."""
    after = history.where(F.col("seq") >= seq)
    back = after.groupBy(*keys).agg(F.min_by("old_value", "seq").alias("value_str"))
    return back, history.where(F.col("seq") < seq)


def with_users(history: DataFrame, users: DataFrame) -> DataFrame:
    """Entries with the names of their authors, null for users who are gone."""
    return history.join(users.select("user_id", F.col("name").alias("user_name")), "user_id", "left")


def newest_of_each(history: DataFrame, by: str, n: int = 50) -> DataFrame:
    """The ``n`` newest entries of each sheet (a report's length)."""
    order = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("seq"))
    return history.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def cleared(history: DataFrame, sheets: DataFrame) -> DataFrame:
    """What is left of a history when that of ``sheets(sheet_id)`` is deleted."""
    return history.join(sheets.select("sheet_id").distinct(), "sheet_id", "left_anti")
