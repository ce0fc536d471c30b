import corpus_pipeline
import pytest
from gridloom.llm import decontamination, mixing, queries, similar, token_index, toxicity
from pyspark.sql import functions as F


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(2)).union(docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6))
    docs = docs.union(odd).withColumn("size", F.lit("clash")).cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    run = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted(map(repr, df.select(*corpus_pipeline.COLUMNS).collect()))

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 1").collect()}
    clean = run["toxicity"](spark, docs, sf)
    assert key(clean) == key(docs.where(F.col("doc_id").isNull() | ~F.col("doc_id").isin(list(bad))))

    one = run["near_duplicates"](spark, clean, sf).cache()
    groups = similar.grouped(clean.withColumns({"s_id": similar._key(), "s_text": F.xxhash64("text")})).select("root").distinct().count()
    assert one.count() == groups < clean.count()

    free = run["decontamination"](spark, one, sf).cache()
    leaks = decontamination.contaminated(one, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id").distinct().count()
    assert leaks > 0 and free.count() == one.count() - leaks

    mix = run["mixing"](spark, free, sf).cache()
    taken = mixing.mix_plan(free).agg(F.sum("taken")).first()[0]
    assert mix.columns == list(corpus_pipeline.COLUMNS) and mix.select(F.sum(mixing.is_word_count(F.col("text")))).first()[0] == taken

    out = run["token_output"](spark, mix, sf)
    assert out.count() == mix.count()


def test_run_and_empty(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
