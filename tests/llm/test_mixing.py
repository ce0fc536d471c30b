import random
import re
from collections import Counter, defaultdict

from gridloom.llm import mixing
from llm_rows import SCHEMA, frame

W = re.compile(r"[^\x20\x09-\x0D]+")


def sainte_lague(votes, most, seats):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(most))):
        i = max((i for i in range(len(votes)) if out[i] < most[i]), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_apportion_against_highest_quotients():
    rnd = random.Random(1)
    for _ in range(200):
        votes = [rnd.choice([0.5, 1, 2, 3.3, 10, rnd.random() * 50]) for _ in range(rnd.randrange(1, 8))]
        most = [rnd.randrange(0, 60) for _ in votes]
        seats = rnd.randrange(0, 120)
        assert mixing.apportion(votes, most, seats) == sainte_lague(votes, most, seats)


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == [200, 2 / 3 * 250, 1 / 3 * 250]
    assert mixing.targets([10, 0, 90], [5, 2, 1], 1.5, 2) == [20, 0, 130]
    assert mixing.targets([], [], 1.5, 2) == []


def corpus(spark, odd_texts):
    rnd = random.Random(3)
    texts = odd_texts + [" ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(1, 300))) for _ in range(300)]
    return texts, frame(spark, texts * 2, lambda i: (None, "b", "a", "é", "Z")[min(4, i % 13 // 2)])


def test_plan(spark, odd_texts):
    texts, df = corpus(spark, odd_texts)
    got = mixing.mix_plan(df).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix_plan(df.repartition(7)).collect()}
    assert len(got) == 2 * len(texts) and again == {(r.doc_id, r.taken) for r in got}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(W.findall((texts * 2)[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
    order = sorted((s for s in size if s is not None)) + [None]
    want = mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)
    for s, t in zip(order, want, strict=True):
        assert target[s] == (t, size[s])
        assert abs(taken[s] - t) <= 0.01 * t
    shard = Counter(k for r in got for p in r.m_parts for k in p.shards for _ in range(p.end - p.start))
    assert len(shard) == 16 and max(shard.values()) < 1.2 * min(shard.values())


def test_rows_hold_the_taken_words(spark, odd_texts):
    texts, df = corpus(spark, odd_texts)
    taken = {r.doc_id: r.taken for r in mixing.mix_plan(df).collect()}
    out = defaultdict(int)
    for r in mixing.mixed_rows(df).collect():
        w = W.findall(r.text or "")
        out[r.doc_id] += len(w)
        assert r.n_chars == len(r.text or "") and not Counter(w) - Counter(W.findall((texts * 2)[r.doc_id] or ""))
    assert {d: out.get(d, 0) for d in taken} == taken
    assert mixing.mix_plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_tiny_source_leaves_the_others_blocks(spark):
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(99)}" for _ in range(300)) for _ in range(600)]
    tiny = ["t " * 50]
    source = lambda i: "z" if i == 600 else "ab"[i % 2]
    plans = [{r.doc_id: r for r in mixing.mix_plan(frame(spark, t, source)).collect()} for t in (texts, texts + tiny)]
    assert 0 < plans[1][600].taken <= 100
    whole = [{d: [(p.start, p.end, len(p.shards)) for p in r.m_parts] for d, r in plan.items() if d < 600} for plan in plans]
    changed = sum(whole[0][d] != whole[1][d] for d in range(600))
    assert changed <= 6  # a target that is a few words less costs a block or so, which one or two documents hold
    assert max(len(v) for v in whole[1].values()) <= max(len(v) for v in whole[0].values())
