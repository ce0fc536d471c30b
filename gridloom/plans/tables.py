"""The driver tables as dimensions and cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods
from ..session import materialized


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def month(ts: str) -> Column:
    return periods.key_at(F.col(ts), "M")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World, regions and nations as records; ids are 1, 10 + region and 1000 + nation."""
    world = spark.sql("select 1L as record_id, cast(null as long) as parent_id, 0 as sort_order, 'World' as name")
    regions = table(spark, sf_dir, "region").selectExpr("10L + r_regionkey", "1L", "r_regionkey", "r_name")
    nations = table(spark, sf_dir, "nation").selectExpr("1000L + n_nationkey", "10L + n_regionkey", "n_nationkey", "n_name")
    return world.union(regions).union(nations).withColumn("analytic_id", F.lit("geo"))


def period_records(keys: DataFrame) -> DataFrame:
    """Period records of ``period_key`` and its ancestors; the key is the id."""
    from ..operators.hierarchy import with_period_ancestors

    every = with_period_ancestors(keys)
    return every.select(F.col("period_key").alias("record_id"), periods.parent_key(F.col("period_key")).alias("parent_id"), "period_key")


def period_closure(keys: DataFrame) -> DataFrame:
    """``(desc, anc)`` of month keys with all their levels, by expressions alone."""
    day = periods.start(F.col("period_key"))
    return keys.select(F.col("period_key").alias("desc"), F.explode(F.array(*[periods.key_at(day, k) for k in periods.LEVELS])).alias("anc"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf facts ``(nation, month, revenue, quantity)``."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_quantity")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy((F.col("c_nationkey") + 1000).cast("long").alias("geo"), month("o_orderdate").alias("period")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum("l_quantity").alias("quantity")
    )


def sales_model(spark: SparkSession, sf_dir: str):
    """All orders by nation, region and world and by month, quarter and year, with four indicators, two of which are rules: input for the general calculation.

    Period ids are year * 10000 + quarter * 100 + month, with zeros for what a coarser period doesn't have.
    """
    from ..operators.calc import Model

    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    # Whole cents as integers: sums don't depend on their order.
    per = (F.year("o_orderdate") * 10000 + F.quarter("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    facts = rows.groupBy(per.alias("per"), (F.col("c_nationkey") + 1000).cast("long").alias("geo")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    facts = materialized(facts, "facts")
    values = F.explode(F.array(F.struct(F.lit(100).cast("long").alias("i"), F.col("cents").alias("v")), F.struct(F.lit(101).cast("long").alias("i"), F.col("n").alias("v"))))
    cells = facts.select("per", "geo", values.alias("x")).select(
        F.lit("s").alias("sheet_id"), F.array("per", "x.i", "geo").alias("coord"), F.col("x.v").cast("string").alias("value_str"), F.lit("manual").alias("rule"), F.lit(None).cast("string").alias("formula")
    )
    make, no_text, no_int = spark.createDataFrame, F.lit(None).cast("string"), F.lit(None).cast("int")
    axes = make([("s", 0, "per", "periods", False, True), ("s", 1, "ind", "indicators", True, False), ("s", 2, "geo", "geography", False, False)],
        "sheet_id string, axis_idx int, analytic_id string, name string, is_main boolean, is_period boolean")
    p = F.col("p")
    each = facts.select(F.explode(F.array("per", F.expr("per div 100 * 100"), F.expr("per div 10000 * 10000"))).alias("p")).distinct()
    year, quarter, month_ = (F.expr(x).cast("int") for x in ("p div 10000", "p div 100 % 100", "p % 100"))
    tail = F.when(month_ > 0, F.format_string("%02d", month_)).when(quarter > 0, F.concat(F.lit("Q"), quarter.cast("string"))).otherwise("Y")
    key = F.concat(year.cast("string"), F.lit("-"), tail)
    parent = F.when(month_ > 0, F.expr("p div 100 * 100")).when(quarter > 0, F.expr("p div 10000 * 10000"))
    periods_ = each.select(p.alias("record_id"), F.lit("per").alias("analytic_id"), parent.alias("parent_id"), p.cast("int").alias("sort_order"), key.alias("name"), key.alias("period_key"), no_int.alias("excel_row"))
    indicators = [(100 + i, "ind", None, i, n, None, None) for i, n in enumerate(("cents", "orders", "mean", "closing"))]
    schema = "record_id long, analytic_id string, parent_id long, sort_order int, name string, period_key string, excel_row int"
    geo = geography(spark, sf_dir).select("record_id", "analytic_id", "parent_id", F.col("sort_order").cast("int"), "name", no_text.alias("period_key"), no_int.alias("excel_row"))
    rules = [("r1", "s", 102, "leaf", None, 0, "INT([cents]/[orders])"), ("r2", "s", 102, "consolidation", None, 0, "INT([cents]/[orders])")]
    rules += [("r3", "s", 103, "leaf", None, 0, '[closing](periods="предыдущий")+[orders]'), ("r4", "s", 103, "consolidation", None, 0, "LAST")]
    return Model(make([("s", "Sales", None)], "sheet_id string, name string, excel_code string"), axes, periods_.union(make(indicators, schema)).union(geo), cells,
        make(rules, "rule_id string, sheet_id string, indicator_id long, kind string, scope map<string,string>, priority int, formula string"))
