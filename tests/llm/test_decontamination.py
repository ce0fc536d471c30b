import random
from itertools import combinations

from gridloom.llm import decontamination as d
from llm_rows import SCHEMA, frame


def slow(text, items):
    """All items and diagonals, without hashing; a stretch must hold a window that some mask accepts."""
    w, out = d.words(text), {}
    for i, t in items:
        x = d.words(t)
        for start in range(-len(x), len(w)):
            same = [0 <= start + k < len(w) and w[start + k] == x[k] for k in range(len(x))]
            span = min(len(x), d.SPAN)
            masks = d.MASKS if len(x) >= d.SPAN else ["1" * len(x)]
            if not any(all(same[k + p] for p, b in enumerate(m) if b == "1") for m in masks for k in range(len(x) - span + 1) if x):
                continue
            a, b = max(0, -start), min(len(x), len(w) - start)
            own = same[a:b]
            best = max((e - s, -s) for s in range(len(own) + 1) for e in range(s, len(own) + 1) if 5 * sum(own[s:e]) >= 4 * (e - s))
            s, e = -best[1], best[0] - best[1]
            while s < e and not own[s]:
                s += 1
            while s < e and not own[e - 1]:
                e -= 1
            n, eq = e - s, sum(own[s:e])
            if n >= min(10, len(x)) and eq >= 0.8 * n and eq > out.get(i, 0):
                out[i] = eq
    return out


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    v = [f"w{i}" for i in range(60)]
    prose = lambda n: [rnd.choice(v) for _ in range(n)]
    items = [(i, " ".join(prose(rnd.choice([4, 11, 12, 14, 30])))) for i in range(12)] + [(50, None), (51, ""), (3, "w1 w2 w3, W4")]
    texts = [None, "", "w1", " ".join(prose(3000))]
    for _, t in items[:12]:
        x = t.split()
        for change in range(5):
            y = list(x)
            for _ in range(change):
                y[rnd.randrange(len(y))] = rnd.choice(["other", *v])
            texts.append(" ".join(prose(20) + [z.upper() + "," for z in y] + prose(20)))
        texts.append(" ".join(prose(5) + x[: len(x) // 2 + 2] + prose(5)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k): e for i, t in enumerate(texts) for k, e in slow(t, [x for x in items if x[0] != 3]).items()}
    for block in (500_000, 40):
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        got = {(r.doc_id, r.item_id): r.n_equal for r in d.contaminated(frame(spark, texts), bench).collect() if r.item_id != 3}
        assert got == want
    assert len(want) > 20
    clean = {r.doc_id for r in d.decontaminated(frame(spark, texts), bench.where("item_id <> 3")).collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in want}
    assert d.contaminated(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert d.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def by_rule_alone(text, item):
    """Whether some diagonal has a passing stretch: no masks, no hashing."""
    w, x = d.words(text), d.words(item)
    for start in range(-len(x), len(w)):
        own = [w[start + k] == x[k] for k in range(len(x)) if 0 <= start + k < len(w)]
        s, e = d.best_stretch(d.np.array(own, bool)) if own else (0, 0)
        if e - s >= min(d.LEAST_WORDS, len(x)) and 5 * sum(own[s:e]) >= 4 * (e - s) and e > s:
            return True
    return False


def test_search_finds_what_the_rule_accepts():
    rnd = random.Random(7)
    v = [f"w{i}" for i in range(400)]
    prose = lambda n: [rnd.choice(v) for _ in range(n)]
    items = [(n * 10 + k, prose(n)) for n in (4, 5, 6, 8, 9, 10, 11, 12, 13, 15, 20, 33) for k in range(3)]
    index = d.Index([(i, " ".join(x)) for i, x in items])
    texts = []
    for _, x in items:
        for _ in range(30):
            y = list(x)
            for k in rnd.sample(range(len(y)), rnd.randrange(len(y) // 5 + 2)):
                y[k] = "other"
            texts.append(" ".join(prose(rnd.randrange(12)) + y + prose(rnd.randrange(12))))
        if len(x) > 11:  # cut-outs that are a whole document, and an item's first words at a document's end
            texts += [" ".join(x[k : k + n]) for n in (10, 11) for k in range(len(x) - n + 1)]
            texts += [" ".join(prose(9) + x[:10]), " ".join(x[-10:] + prose(9))]
    found = 0
    for t in texts:
        ids = d.np.array([index.vocabulary.get(w, 0) for w in d.words(t)], d.np.int32)
        got = {index.item_ids[o[0]] for o in d.overlaps(index, ids)}
        assert got == {i for i, x in items if by_rule_alone(t, " ".join(x))}, t
        found += len(got)
    assert found > 500


def test_masks_cover_every_placing_of_unequal_words():
    ones = [[i for i, b in enumerate(m) if b == "1"] for m in d.MASKS]
    for n in range(d.LEAST_WORDS, 2 * d.LEAST_WORDS):
        for other in combinations(range(1, n - 1), n // 5):
            assert any(not any(k + i in other for i in m) for m in ones for k in range(n - d.SPAN + 1)), (n, other)


def test_rows_are_removed_by_their_own_text(spark, monkeypatch):
    item, other = " ".join(f"q{i}" for i in range(30)), " ".join(f"z{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    rows = [(None, f"x {item} y"), (None, "clean without an id"), (None, None), (7, f"{other} y"), (7, "clean of the same id"), (8, "clean"), (8, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (500_000, 30):
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        got = [(r.doc_id, r.text) for r in d.decontaminated(df, bench).collect()]
        assert sorted(got, key=str) == sorted((rows[i] for i in (1, 2, 4, 5, 6)), key=str)
