"""What several operators share: the word pattern, the shared folder, tables that cut lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests) is a temporary folder made and set.
    """
    sc = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir().isEmpty():
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = found or tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found or sc.getCheckpointDir().get()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path, not yet made, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so a lost executor costs a read, not a rerun."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_word_count(text):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", ways: int = 16) -> DataFrame:
    """``many`` joined to ``one``, a table with each key once: a key that holds a large part of ``many`` is dealt to ``ways`` tasks."""
    salt = F.pmod(F.xxhash64(F.lit(5), *many.columns), F.lit(ways)).cast("int")
    dealt = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return many.withColumn("_salt", salt).join(dealt, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars.

    Returns ``(node, root)`` for each node with an edge to another one, root being the smallest node of its
    component. Each round aggregates minima map-side first and joins them back, so a node with very many edges is
    never gathered; each round ends in a written table.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        state = [F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("h")]
        now = written(hung.union(small.select("u", F.col("m").alias("v"))).distinct().observe(seen, *state), "edges")
        if seen.get == before:
            break
        before = seen.get
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
