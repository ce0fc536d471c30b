from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def rows(texts, source=lambda i: "s"):
    return [(i, t, "en", source(i), len(t or ""), "clash") for i, t in enumerate(texts)]


def frame(spark: SparkSession, texts, source=lambda i: "s") -> DataFrame:
    return spark.createDataFrame(rows(texts, source), SCHEMA)
