import re
from itertools import combinations

import numpy as np
import xxhash
from gridloom.llm import simhash

from llm_rows import SCHEMA, frame


def slow(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    g = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Brute force over all pairs of distinct fingerprints."""
    least = {}
    for d, f in prints:
        least[f] = min(least.get(f, d), d)
    parent = {f: f for f in least}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(least, 2):
        if (a ^ b).bit_count() <= 4:
            parent[top(a)] = top(b)
    out = {}
    for f in least:
        out[top(f)] = min(out.get(top(f), least[f]), least[f])
    return {d: out[top(f)] for d, f in prints}


def test_against_brute_force(spark, odd_texts):
    df = frame(spark, odd_texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = [(i, slow(t)) for i, t in enumerate(odd_texts)]
    assert {i: int(v[0], 16) for i, v in got.items()} == dict(want)
    assert {i: v[1] for i, v in got.items()} == classes(want)


def test_links_of_crowded_lists(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    center = rnd.integers(0, 2**63, 4, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rnd.integers(0, 64, rnd.integers(1, 6))) for c in center for _ in range(60)]
    fps = sorted(set(near) | {int(x) for x in rnd.integers(0, 2**63, 200)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = classes([(i, f) for i, f in enumerate(fps)])
    for most, short in ((2048, 24), (20, 4), (2048, 2)):
        monkeypatch.setattr(simhash, "LIST", most)
        monkeypatch.setattr(simhash, "SHORT", short)
        root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
        groups = {}
        for i, s in enumerate(signed):
            groups.setdefault(root.get(s, s), set()).add(i)
        other = {}
        for i, c in want.items():
            other.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
