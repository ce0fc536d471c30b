import shutil

import pytest
from gridloom.plans import catalog
from oracle import differences
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def large(spark, sf, tmp_path_factory):
    """The smallest tables with order totals some ten thousand times as large, as the sums of many more orders are."""
    d = str(tmp_path_factory.mktemp("large") / "sf")
    shutil.copytree(sf, d, ignore=shutil.ignore_patterns("orders.parquet"))
    total = F.round(F.col("o_totalprice") * 9973, 2)
    spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_totalprice", total).coalesce(1).write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["generated_model", "saved_edits", "undone_edits"])
def test_large_totals_equal_sql(spark, large, name):
    sql = catalog.oracle_sql()[name].replace("from orders ", f"from read_parquet('{large}/orders.parquet/*.parquet') ")
    assert differences(spark, large, catalog.queries()[name], sql) == ""


@pytest.mark.parametrize("name", ["saved_edits", "undone_edits"])
def test_same_path_with_other_values_equals_sql(spark, sf, large, tmp_path, name):
    """A calculation kept under a path isn't used again when other values, or fewer, are there."""
    d = str(tmp_path / "sf")
    shutil.copytree(sf, d, ignore=shutil.ignore_patterns("orders.parquet"))
    sql = catalog.oracle_sql()[name].replace("from orders ", f"from read_parquet('{d}/orders.parquet/*.parquet') ")
    first = spark.read.parquet(f"{sf}/orders.parquet")
    for orders in (first, spark.read.parquet(f"{large}/orders.parquet"), first.where("o_custkey % 2 = 0")):
        orders.coalesce(1).write.mode("overwrite").parquet(f"{d}/orders.parquet")
        assert differences(spark, d, catalog.queries()[name], sql) == ""
