import random
import re

import numpy as np
import pandas as pd
import pytest
from gridloom.llm import similar
from pyspark.sql import functions as F

from llm_rows import SCHEMA, frame


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts, least=0.8):
    """Brute force: components of all pairs of texts."""
    sets, top = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= least:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]

    def changed(text, n):
        w = text.split(" ")
        for i in rnd.sample(range(len(w)), n):
            w[i] = rnd.choice(words)
        return " ".join(w)

    return lambda n: " ".join(rnd.choice(words) for _ in range(n)), changed


def test_against_brute_force(spark, prose, odd_texts):
    make, changed = prose
    base = [make(n) for n in (60, 150, 400, 900)]
    texts = odd_texts + base + [changed(b, k) for b in base for k in (1, 1, 2, 5, 12, 60)] + [make(120) for _ in range(20)] + [b + " tail" for b in base]
    got = {r.doc_id: r.group_id for r in similar.near_groups(frame(spark, texts)).collect()}
    assert got == dict(enumerate(groups(texts)))


def test_crowd_of_near_copies(spark, prose, monkeypatch):
    """Lists that hold a crowd are told by their smallest members and finer lists; the crowd stays one group, others stay apart."""
    make, changed = prose
    one, two = make(200), make(200)
    texts = [changed(one, 2) for _ in range(150)] + [changed(two, 2) for _ in range(60)] + [make(200) for _ in range(30)]
    for most, dense in ((2048, 16), (8, 16), (2048, 1)):
        monkeypatch.setattr(similar, "LIST", most)
        monkeypatch.setattr(similar, "DENSE", dense)
        got = {r.doc_id: r.group_id for r in similar.near_groups(frame(spark, texts)).collect()}
        assert got == dict(enumerate(groups(texts)))


def test_recall_of_the_index(prose):
    """Of pairs at each similarity the share that meets under some key and is within the distance."""
    make, changed = prose
    memory = similar.Words()
    hits = {}
    for _ in range(400):
        a = make(300)
        b = changed(a, random.randrange(1, 8))
        s = alike(grams(a), grams(b))
        x, y = (similar.fingerprint(similar.shingles(t, memory)) for t in (a, b))
        same = (x ^ y).view(np.uint8) == 0
        ok = same[similar.TRIPLES].all(1).any() and np.bitwise_count(x ^ y).sum() <= similar.FAR and np.bitwise_count(x[0] ^ y[0]) <= similar.FAR_LANE
        hits.setdefault(int(s * 20) / 20, []).append(ok)
    assert all(np.mean(v) >= (0.8 if k < 0.85 else 0.95) for k, v in hits.items() if k >= 0.8 and len(v) > 20)
    assert np.mean([x for k, v in hits.items() if k >= 0.8 for x in v]) >= 0.93


def test_lists_across_batches():
    rnd = np.random.default_rng(2)
    keys = np.sort(rnd.integers(0, 400, 6000))
    rows = pd.DataFrame({"key": keys, "id": np.arange(6000), "lane": rnd.integers(-(2**63), 2**63, 5)[rnd.integers(0, 5, 6000)], "root": np.arange(6000) // 2})
    whole = pd.concat(list(similar._lists(iter([rows]))))
    parts = pd.concat(list(similar._lists(iter(rows.iloc[i : i + 37] for i in range(0, 6000, 37)))))
    norm = lambda x: sorted(map(str, x.itertuples(index=False)))
    assert norm(whole) == norm(parts) and len(whole) > 0


def test_nulls_and_empty(spark):
    assert similar.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (None, ""), (9, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in similar.one_of_each(df).collect())
    assert [g for g in got if g[0] != "None"] == [("7", "a b c d e f"), ("9", "other words")] and len(got) == 3


def test_no_pair_of_a_crowded_list_is_lost(spark):
    """Of lists that are long and hold several groups every close pair is compared, whatever the smallest member is like."""
    rnd = np.random.default_rng(4)
    centre = rnd.integers(-(2**63), 2**63, similar.LANES)
    near = lambda fp, n: (np.unpackbits(fp.view(np.uint8)) ^ np.isin(np.arange(1024), rnd.choice(np.arange(64, 1024), n, replace=False))).astype(np.uint8)
    prints = [np.packbits(near(centre, 150)).view(np.int64) for _ in range(60)]
    prints += [np.packbits(near(p, 40)).view(np.int64) for p in prints[:30]]
    classes = spark.createDataFrame([(i, [int(x) for x in p]) for i, p in enumerate(prints)], "id long, fp array<long>")
    members = classes.selectExpr("1L as key", "id", "id div 45 as root")
    want = {(a, b) for b in range(90) for a in range(b) if a // 45 != b // 45 and np.bitwise_count(prints[a].view(np.uint64) ^ prints[b].view(np.uint64)).sum() <= similar.FAR}
    assert len(want) >= 15
    for block in (4096, 20):
        before, similar.BLOCK = similar.BLOCK, block
        try:
            got = {(r.a, r.b) for r in similar.candidates_left(members, classes).collect()}
        finally:
            similar.BLOCK = before
        assert got == want


def test_finer_crowds_are_told_apart_exactly(spark, prose, monkeypatch):
    """Groups whose lists are crowds at every level, so that smallest members alone would not find all links."""
    make, changed = prose
    one = make(200)
    texts = [t for _ in range(25) for b in [changed(one, 9)] for t in (b, changed(b, 1), changed(b, 2))]
    monkeypatch.setattr(similar, "LIST", 4)
    monkeypatch.setattr(similar, "DENSE", 0)
    got = {r.doc_id: r.group_id for r in similar.near_groups(frame(spark, texts)).collect()}
    assert got == dict(enumerate(groups(texts)))


def test_rows_of_lists_grow_with_members():
    """A list of close members of different groups gives a row for each of them, whatever its length, not one for each pair."""
    for m in (10, 500, 1000, 2000, 9000):
        rows = pd.DataFrame({"key": 7, "id": np.arange(m), "lane": np.arange(m) % 4, "root": np.arange(m)})
        got = pd.concat(list(similar._lists(iter(rows.iloc[i : i + 700] for i in range(0, m, 700)))))
        assert len(got) == m and sorted(got.a) == list(range(m))


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_roots_are_components(spark, most):
    """Groups of links, contracted in one task and in several."""
    rnd = np.random.default_rng(6)
    pairs = rnd.integers(0, 120, (70, 2)).tolist() + [[i, i + 1] for i in range(200, 260)]
    of = {x: x for p in pairs for x in p}
    while any(of[a] != of[b] for a, b in pairs):
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    assert {r.id: r.root for r in similar._roots(links, most).collect()} == {k: v for k, v in of.items() if k != v}


def test_roots_take_few_jobs(spark):
    """Links that one task holds are contracted there, without rounds of joins over all of them."""
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    group = "roots of few links"
    spark.sparkContext.setJobGroup(group, group)
    similar._roots(links)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 4


def test_prints_are_joined_once_for_a_class(spark):
    """The join with the fingerprints makes a row for each class, not for each list that a class is in."""
    classes = spark.createDataFrame([(i, [i, -i]) for i in range(9)], "id long, fp array<long>")
    members = spark.range(50).crossJoin(classes.select(F.col("id").alias("c"))).selectExpr("id as key", "c as id", "c div 2 as root")
    got = similar.with_prints(members, classes)
    assert {(r.key, r.id, r.root, tuple(r.fp)) for r in got.collect()} == {(k, i, i // 2, (i, -i)) for k in range(50) for i in range(9)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("collect_list")
