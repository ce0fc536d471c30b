"""Dimension trees: closure, leaves, order, generated periods, previous and next periods, parents from indentation.

Records have ``record_id, analytic_id, parent_id, sort_order, name`` and, for periods, ``period_key``. A parent that isn't
among the records makes its record a root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods
from ..session import materialized


def closure(records: DataFrame) -> DataFrame:
    """``(desc, anc, depth)`` for every record and each of its ancestors, itself included with depth 0.

    Jumps double in each round, so a tree of depth d takes log2(d) of them; three rounds are one job. A cycle of parents is an error.
    """
    nodes = records.select("record_id", "parent_id").distinct()
    pairs = nodes.select(F.col("record_id").alias("desc"), F.col("record_id").alias("anc"), F.lit(0).alias("depth"))
    known = nodes.select(F.col("record_id").alias("anc"))
    jumps = nodes.select(F.col("record_id").alias("desc"), F.col("parent_id").alias("anc"), F.lit(1).alias("depth"))
    jumps, rounds = materialized(jumps.join(known, "anc", "left_semi").select("desc", "anc", "depth"), "jumps"), 0
    while True:
        for _ in range(3):
            step = jumps.select(F.col("desc").alias("mid"), F.col("anc").alias("top"), F.col("depth").alias("more"))
            longer = lambda x: x.join(step, x.anc == step.mid).select("desc", F.col("top").alias("anc"), (F.col("depth") + F.col("more")).alias("depth"))  # noqa: E731, B023
            pairs, jumps = pairs.union(longer(pairs)), longer(jumps)
        pairs, jumps, rounds = materialized(pairs, "closure"), materialized(jumps, "jumps"), rounds + 3
        if jumps.isEmpty():
            return pairs
        if rounds > 30 or (rounds > 6 and not jumps.where("desc = anc").isEmpty()):
            raise ValueError("the parents of some records form a cycle")


def with_kids(records: DataFrame) -> DataFrame:
    """Adds ``has_kids``."""
    parents = records.select(F.col("parent_id").alias("record_id")).where("record_id is not null").distinct().withColumn("k", F.lit(True))
    return records.join(parents, "record_id", "left").withColumn("has_kids", F.coalesce("k", F.lit(False))).drop("k")


def leaves(records: DataFrame) -> DataFrame:
    return records.join(records.select(F.col("parent_id").alias("record_id")), "record_id", "left_anti")


def first_leaves(records: DataFrame) -> DataFrame:
    """``(analytic_id, record_id)``: the first leaf of each analytic by sort_order."""
    return leaves(records).groupBy("analytic_id").agg(F.min_by("record_id", F.struct("sort_order", "record_id")).alias("record_id"))


def in_tree_order(records: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """With ``tree``, the closure where it is at hand, adds ``tree_path`` (sort key of the pre-order), ``names`` (from the root down) and ``depth``."""
    up = (closure(records) if tree is None else tree).alias("c").join(records.alias("a"), F.expr("c.anc = a.record_id"))
    steps = F.sort_array(F.collect_list(F.struct((-F.col("c.depth")).alias("d"), F.col("a.sort_order").alias("s"), F.col("anc").alias("r"), F.col("a.name").alias("n"))))
    walks = up.groupBy(F.col("desc").alias("record_id")).agg(steps.alias("w"))
    walks = walks.select("record_id", F.transform("w", lambda x: F.struct(x["s"], x["r"])).alias("tree_path"), F.transform("w", lambda x: x["n"]).alias("names"), (F.size("w") - 1).alias("depth"))
    return records.join(walks, "record_id")


def with_ancestors(records: DataFrame, hit: Column) -> DataFrame:
    """Records for which ``hit`` holds, and all their ancestors."""
    found = closure(records).join(records.where(hit).select(F.col("record_id").alias("desc")), "desc", "left_semi")
    return records.join(found.select(F.col("anc").alias("record_id")).distinct(), "record_id", "left_semi")


def subtree(records: DataFrame, root: Column) -> DataFrame:
    """Records below and including those for which ``root`` holds."""
    found = closure(records).join(records.where(root).select(F.col("record_id").alias("anc")), "anc", "left_semi")
    return records.join(found.select(F.col("desc").alias("record_id")).distinct(), "record_id", "left_semi")


def generate_periods(spark: SparkSession, start: str, end: str, levels: tuple[str, ...] = ("M", "Q", "Y")) -> DataFrame:
    """``(period_key, parent_key, level, start, end)`` of all periods that meet [start, end], clamped to it."""
    months = spark.sql("select explode(sequence(trunc(cast(:a as date), 'MM'), cast(:b as date), interval 1 month)) as m", args={"a": start, "b": end})
    keys = reduce(DataFrame.union, [months.select(periods.key_at(F.col("m"), k).alias("period_key")) for k in periods.LEVELS if k in levels]).distinct()
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return keys.select(
        "period_key",
        periods.parent_key(F.col("period_key"), levels).alias("parent_key"),
        periods.level(F.col("period_key")).alias("level"),
        F.greatest(periods.start(F.col("period_key")), first).alias("start"),
        F.least(periods.end(F.col("period_key")), last).alias("end"),
    )


def with_period_ancestors(keys: DataFrame, levels: tuple[str, ...] = ("M", "Q", "H", "Y")) -> DataFrame:
    """Distinct ``period_key`` of ``keys`` and of all coarser periods that hold them."""
    day, own = periods.start(F.col("period_key")), periods.rank(F.col("period_key"))
    more = F.array(*[F.when(F.lit(periods.LEVELS[k]) > own, periods.key_at(day, k)) for k in levels])
    every = F.array_append(F.array_compact(more), F.col("period_key"))
    return keys.where(own.isNotNull()).select(F.explode(every).alias("period_key")).distinct()


def period_chains(records: DataFrame) -> DataFrame:
    """``(analytic_id, record_id, level, idx)``: the place of each period in the chain of its level.

    Levels come from period keys; records without one form the chain of the leaves.
    """
    level = F.coalesce(periods.level(F.col("period_key")), F.when(~F.col("has_kids"), "leaf"))
    order = Window.partitionBy("analytic_id", "level").orderBy("sort_order", "record_id")
    rows = with_kids(records).withColumn("level", level).where("level is not null")
    return rows.select("analytic_id", "record_id", "level", F.row_number().over(order).alias("idx"))


def shifted(chains: DataFrame, n: int) -> DataFrame:
    """``(record_id, to_id)``: the period ``n`` places ahead (before, if negative); no row beyond the ends."""
    to = chains.select("analytic_id", "level", F.col("record_id").alias("to_id"), (F.col("idx") - n).alias("idx"))
    return chains.join(to, ["analytic_id", "level", "idx"]).select("record_id", "to_id")


def parents_by_indent(rows: DataFrame, most_levels: int = 16) -> DataFrame:
    """Adds ``parent_pos`` to ``rows(sheet_id, pos, indent)``: the nearest row above that is indented less.

    Indents are from 0 to ``most_levels`` - 1 (spreadsheets have 15 at most); one window holds all of them.
    """
    above = Window.partitionBy("sheet_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("indent") == k, F.col("pos"))).over(above) for k in range(most_levels)]
    nearest = F.array_max(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), p.alias("p")) for k, p in enumerate(last)]), lambda x: (x["k"] < F.col("indent")) & x["p"].isNotNull()).getField("p"))
    return rows.withColumn("parent_pos", nearest)


def numbered_siblings(records: DataFrame) -> DataFrame:
    """``name`` gets `` #n`` from the second record on that has the same parent and, lower-cased, the same name."""
    w = Window.partitionBy("parent_id", F.lower("name")).orderBy("sort_order", "record_id")
    n = F.row_number().over(w)
    return records.withColumn("name", F.when(n > 1, F.concat("name", F.lit(" #"), n.cast("string"))).otherwise(F.col("name")))


def nearest_common(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, anc, depth)``: the lowest node above both of each of ``pairs(a, b)``, the nodes themselves included; ``tree`` is a closure."""
    up = lambda c, d: tree.select(F.col("desc").alias(c), "anc", F.col("depth").alias(d))
    both = pairs.join(up("a", "d1"), "a").join(up("b", "d2"), ["b", "anc"])
    best = both.groupBy("a", "b").agg(F.min(F.struct((F.col("d1") + F.col("d2")).alias("depth"), "anc")).alias("m"))
    return best.select("a", "b", "m.anc", "m.depth")


def from_levels(rows: DataFrame, levels: list[str], analytic_id: str) -> DataFrame:
    """Records from a table with one column for each level, top first: one record for each distinct path, numbered by name among its siblings.

    A path ends at its first null; ids are hashes of the path.
    """
    paths = [F.array(*levels[: k + 1]) for k in range(len(levels))]
    each = rows.select(F.explode(F.array(*paths)).alias("p")).where(F.forall("p", lambda x: x.isNotNull())).distinct()
    parent = F.when(F.size("p") > 1, F.xxhash64(F.slice("p", 1, F.size("p") - 1)))
    records = each.select(F.xxhash64("p").alias("record_id"), F.lit(analytic_id).alias("analytic_id"), parent.alias("parent_id"), F.element_at("p", -1).alias("name"))
    return records.withColumn("sort_order", F.row_number().over(Window.partitionBy("parent_id").orderBy("name")) - 1)
