import random

import numpy as np
from gridloom.llm import toxicity
from llm_rows import SCHEMA, frame


def corpus(n, seed):
    rnd = random.Random(seed)
    v, bad = [f"word{i}" for i in range(300)], ["vile", "nasty", "rotten"]
    texts, y = [], []
    for _ in range(n):
        w = [rnd.choice([*v, "the", "of", "and"]) for _ in range(rnd.randrange(5, 80))]
        toxic = rnd.random() < 0.25
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(bad)
        texts.append(" ".join(w).capitalize() + ".")
        y.append(int(toxic))
    return texts, y


def test_held_out_accuracy(spark):
    texts, y = corpus(500, 1)
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, v, "x") for i, v in enumerate(y)], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(df, labels).collect()}
    held = [i for i in range(500) if got[i].held_out]
    assert 60 < len(held) < 140
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(500))
    right = [got[i].predicted == y[i] for i in held]
    assert np.mean(right) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_held_out_labels_and_other_columns_dont_matter(spark):
    texts, y = corpus(120, 2)
    df = frame(spark, texts)
    both = []
    for flip in (False, True):
        lab = [(i, 1 - v if flip and __import__("zlib").crc32(str(i).encode()) % 5 == 0 else v) for i, v in enumerate(y)]
        labels = spark.createDataFrame(lab, "doc_id long, toxic int")
        d = df if not flip else df.selectExpr("doc_id", "text", "'zz' as lang", "'yy' as source")
        both.append({r.doc_id: r.score for r in toxicity.toxicity_scores(d, labels).collect()})
    assert both[0] == both[1]


def test_odd_rows(spark, odd_texts):
    labels = spark.createDataFrame([(0, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(frame(spark, odd_texts), labels).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(spark.createDataFrame([], SCHEMA), labels.limit(0)).count() == 0


def test_long_texts_are_scored_whole(monkeypatch):
    texts, y = corpus(200, 3)
    model = toxicity.train(texts, np.array(y))
    coder = toxicity.Coder(model)
    rows = coder.codes(" ".join(texts)) >> 3
    whole = toxicity.logit(model, coder.vectors, rows)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert abs(toxicity.logit(model, coder.vectors, rows) - whole) < 1e-4


def test_passages_far_inside_long_texts_are_learned(spark):
    rnd = random.Random(4)
    v = [f"word{i}" for i in range(200)]
    y = [int(i % 4 == 0) for i in range(160)]
    texts = [" ".join([rnd.choice(v) for _ in range(1500)] + ["vile" if t else "kind"] + [rnd.choice(v) for _ in range(50)]) for t in y]
    assert min(t.index(w) for t, w in zip(texts, ("vile" if t else "kind" for t in y))) > 8000
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(frame(spark, texts), labels).collect()}
    assert np.mean([got[i] == t for i, t in enumerate(y)]) > 0.95


def test_all_labelled_rows_are_counted(spark, monkeypatch):
    """Counts, weights and thresholds come from every labelled row, also from more rows and tasks than one learns from at once."""
    texts, y = corpus(6000, 5)
    df = frame(spark, [f"only{i} {t}" for i, t in enumerate(texts)])
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    seen, calls = [], toxicity.vocabulary
    monkeypatch.setattr(toxicity, "vocabulary", lambda rows, n: seen.append((rows.count(), n)) or calls(rows, n))
    monkeypatch.setattr(toxicity, "CHUNK", 50_000)
    model = toxicity.fit(df, labels, toxicity.fold(5) != 0)
    held = sum(__import__("zlib").crc32(str(i).encode()) % 5 == 0 for i in range(6000))
    rows = spark.createDataFrame([(i,) for i in range(6000)], "doc_id long").where(toxicity.fold(5) != 0)
    set_apart = rows.where("pmod(xxhash64(31, doc_id), 4) = 3").count()
    assert seen == [(6000 - held - set_apart,) * 2] and seen[0][0] > 3400
    scores = [toxicity.score_of(model, toxicity.coder_of(model), t)[0] >= 0.5 for t in texts]
    assert np.mean([s == bool(t) for s, t in zip(scores, y)]) > 0.97
    again = toxicity.fit(df, labels, toxicity.fold(5) != 0)
    assert all((a == b).all() for a, b in zip((model.table, *model.filters), (again.table, *again.filters))) and model.thresholds == again.thresholds


def test_counts_of_a_model_are_those_of_all_rows(spark, monkeypatch):
    texts = ["vile day", "vile night", "kind day", "kind night", "day"]
    rows = spark.createDataFrame([(t, float(i < 2)) for i, t in enumerate(texts)], "text string, y double").repartition(3)
    count = lambda: {int(b): (int(x), int(z)) for b, x, z in zip(*toxicity.vocabulary(rows, 5))}
    assert count()[toxicity.bucket("day")] == (2, 1) and count()[toxicity.bucket("vile")] == (0, 2) and count()[toxicity.bucket("kind~")] == (2, 0)
    monkeypatch.setattr(toxicity, "VOCABULARY", 1)
    assert count() == {toxicity.bucket("day"): (2, 1)}
