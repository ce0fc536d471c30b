import hashlib
import random
from collections import Counter

import pytest
from gridloom.llm import suffix

from llm_rows import SCHEMA, frame

N = suffix.LENGTH


def slow(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + N] for d in data for i in range(len(d) - N + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - N + 1):
            if count[d[i : i + N]] > 1:
                gone[i : i + N] = b"\1" * N
        left = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeéfghi日") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, other, short = prose(140), prose(90), prose(50)
    out = [None, "", "a", "x" * 399, "y" * 400, "z" * 401, "ab" * 700, prose(300), prose(10)]
    out += [prose(rnd.randrange(5, 60)) + " " + shared + prose(rnd.randrange(60)) for _ in range(6)]
    out += [other[:a] + "!" + other[a:] for a in (0, 30, 200, 400)] + [other, other, short, short + short + "x" + short]
    base = prose(400)
    for _ in range(6):
        w = base.split(" ")
        for _ in range(3):
            w[rnd.randrange(len(w))] = word()
        out.append(" ".join(w))
    cut = shared.encode()[:N].decode(errors="ignore")
    out += [cut + " tail", "head " + cut, shared[50:] + other[100:], base[:900] + shared[:300] + base[:900]]
    return out


def test_against_brute_force(spark, texts, monkeypatch):
    want = dict(enumerate(slow(texts)))
    for crowd, piece in ((8000, 1 << 20), (1, 1000)):
        monkeypatch.setattr(suffix, "CROWD", crowd)
        monkeypatch.setattr(suffix, "PIECE", piece)
        got = {r.doc_id: tuple(r)[1:] for r in suffix.without_repeats(frame(spark, texts)).collect()}
        assert got == want


def test_blocks_cover_each_window_once(texts):
    data = [t.encode() for t in texts if t and len(t.encode()) >= N]
    seen = Counter()
    for t, s, n, *_ in zip(*suffix.blocks(data)):
        seen.update((t, s + i) for i in range(n))
    assert seen == Counter((t, i) for t, d in enumerate(data) for i in range(len(d) - N + 1))


def test_empty(spark):
    assert suffix.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_multikey_quicksort():
    import numpy as np

    rnd = np.random.default_rng(4)
    data = rnd.integers(0, 2, 3000, dtype=np.uint8)
    data[1000:1900] = data[:900]
    data[2200:2650] = data[100:550]
    at = np.arange(3000 - N + 1)
    for group in (np.zeros(len(at), np.int64), at % 3):
        count = Counter((int(g), data[i : i + N].tobytes()) for i, g in zip(at, group))
        want = [count[int(g), data[i : i + N].tobytes()] > 1 for i, g in zip(at, group)]
        assert suffix.tied(data, at, group).tolist() == want and any(want)
    assert suffix.tied(data, at[:0], at[:0]).tolist() == []
