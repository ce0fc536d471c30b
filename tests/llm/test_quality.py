import random
import re
import zlib
from collections import Counter

import numpy as np
from gridloom.llm import decision_list, rule_ensemble, stats
from llm_rows import SCHEMA, frame

W = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    t = text or ""
    w = W.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    k = Counter(grams)
    covered = {j for i, g in enumerate(grams) if k[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def corpus(n, seed):
    rnd = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        w = [f"word{rnd.randrange(500)}" for _ in range(rnd.randrange(12, 120))]
        bad = rnd.random() < 0.3
        if bad:
            kind = rnd.randrange(3)
            w = [x + "%%%" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [w[0]] * len(w)
        texts.append(" ".join(w) + "\n" + w[0])
        y.append(int(not bad))
    return texts, y


def test_base_statistics(spark, odd_texts):
    texts = odd_texts + ["a b\na b\n\n a b\n", "# x # x # x # x # x <p> | &", "q w e r t q w e r t", "l1\nl1\nl2\nl1", "é é é é é é"]
    got = {r.doc_id: r for r in stats.with_statistics(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow(t), t
        assert r.n_distinct == len(set(W.findall(t or "")))


def labelled(spark, seed=1):
    texts, y = corpus(400, seed)
    return texts, y, frame(spark, texts), spark.createDataFrame([(i, v, "clash") for i, v in enumerate(y)], "doc_id long, quality int, text string")


def test_decision_list(spark, odd_texts):
    texts, y, df, labels = labelled(spark)
    got = {r.doc_id: r for r in decision_list.quality_rules(df, labels).collect()}
    assert np.mean([got[i].kept == bool(v) for i, v in enumerate(y)]) > 0.97
    for i, t in enumerate(texts):
        n, *_, repeat = slow(t)
        assert got[i].base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (got[i].kept and got[i].base_failed)
    odd = decision_list.quality_rules(frame(spark, odd_texts), labels.limit(0)).collect()
    assert len(odd) == len(odd_texts) and all(r.kept != r.base_failed for r in odd)
    assert decision_list.quality_rules(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_learned_rules_are_what_the_expression_says(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((300, 2)), 3)
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.5)
    rules = decision_list.learn(x, bad, ["a", "b"])
    hit = np.zeros(300, int)
    for k, r in reversed(list(enumerate(rules, 1))):
        hit[decision_list._holds(x, ["a", "b"], r)] = k
    assert rules and np.mean((hit > 0) == bad) > 0.97
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, f_a double, f_b double")
    assert [r.k for r in df.select("i", decision_list.compiled(rules).alias("k")).orderBy("i").collect()] == hit.tolist()
    assert decision_list.learn(x, np.zeros(300, bool), ["a", "b"]) == []


def test_rule_ensemble(spark, odd_texts):
    _, y, df, labels = labelled(spark, 5)
    got = {r.doc_id: r for r in rule_ensemble.quality_scores(df, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    assert np.mean([got[i].predicted == v for i, v in enumerate(y) if got[i].held_out]) > 0.97
    flipped = spark.createDataFrame([(i, 1 - v if got[i].held_out else v) for i, v in enumerate(y)], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in rule_ensemble.quality_scores(df, flipped).collect()}
    assert again == {d: r.score for d, r in got.items()}
    odd = rule_ensemble.quality_scores(frame(spark, odd_texts), labels).collect()
    assert len(odd) == len(odd_texts) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in rule_ensemble.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert rule_ensemble.quality_scores(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_ensemble_is_what_the_expression_says(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((300, 2)), 3)
    y = ((x[:, 0] > 0.6) | (x[:, 1] < 0.2)).astype(float)
    rules, b = rule_ensemble.learn(x, y, ["a", "b"])
    z = b + sum(w * rule_ensemble.holds(x, ["a", "b"], r) for r, w in rules)
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], "i int, f_a double, f_b double")
    got = [r.s for r in df.select("i", rule_ensemble.compiled(rules, b).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and np.mean((np.array(got) >= 0.5) == y) > 0.97


def test_sample_with_repeated_ids(spark):
    """Repeated and null ids: one text for each labelled id, the same in every run, never more than the bound."""
    from gridloom.llm.stats import labelled_sample
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k % 7, f"text {k}") for k in range(70)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)] + [(None, 1), (8, None)], "doc_id long, quality int")
    runs = [sorted(map(tuple, labelled_sample(d, labels, "quality", F.lit(True), 5).collect()), key=str) for d in (docs, docs.repartition(3))]
    assert runs[0] == runs[1] and len(runs[0]) == len({r[0] for r in runs[0]}) == 5
