"""Benchmark decontamination by spaced-seed hashing.

A fixed mask selects some of ten consecutive word positions and ignores the others, so the hash of the selected
words survives a substitution at an ignored position. Hashes of all benchmark windows under every mask are joined with
those of the documents; around each hit the document and the item are laid over each other on the hit's diagonal and the
longest stretch with four fifths of equal words is kept if it has ``LEAST_WORDS`` words (or the whole of a shorter item).

The masks miss no such stretch: one of 20 words or more holds one of 10 to 19 with four fifths equal, and for each way
to place the unequal words in 10 to 19 some mask fits inside (a test goes through all). Items below ten words have a mask for each
inner position that may differ.

The benchmark is the query set. It is taken in blocks of at most ``BLOCK_WORDS`` words, each a small sorted table that
every task joins its documents with; more benchmark gives more blocks, not larger ones.

Cases: null and empty items match nothing, null and empty texts have no hits; items below five words must be there
word for word; repeated items and rows give repeated results; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_word_count

# The masks, 1 for a selected position.
MASKS = ("1010101011", "1100011011", "1110110001", "1001001111", "1011100101", "1101010101", "1011111110")
SPAN = len(MASKS[0])
LEAST_WORDS, LEAST_SHARE, MISMATCH = 10, 0.8, 4
BLOCK_WORDS = 500_000
MEMORY_WORDS = 500_000
_MULT = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(64)], np.uint64)


def normal(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>|#*$%&-_`~")


def words(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := normal(x))]


def _keys(ids: np.ndarray, at: np.ndarray, picks: list[int], salt: int) -> np.ndarray:
    h = np.full(len(at), salt * 0x51ED270B + 1, np.uint64)
    for k, p in enumerate(picks):
        h = h * _MULT[k] + ids[at + p].astype(np.uint64)
        h ^= h >> np.uint64(31)
    return h


def short_picks(n: int) -> list[list[int]]:
    """Selected positions of the masks of an item of ``n < SPAN`` words: all, but for one inner word where a fifth may differ."""
    return [[i for i in range(n) if i != j] for j in range(1, n - 1)] if n >= MISMATCH + 1 else [list(range(n))]


class Index:
    """One block of the benchmark: word ids, items as id arrays, and for each mask its sorted hashes with item and place."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.item_ids, self.items = [], []
        for item, text in items:
            if w := words(text):
                self.item_ids.append(item)
                self.items.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int32))
        self.tables = []
        short = sorted({len(x) for x in self.items if len(x) < SPAN})
        masks = [[i for i, b in enumerate(m) if b == "1"] for m in MASKS]
        layout = [(m, SPAN, lambda n: n >= SPAN) for m in masks] + [(m, k, lambda n, k=k: n == k) for k in short for m in short_picks(k)]
        for salt, (picks, span, fits) in enumerate(layout):
            keys, item, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, x in enumerate(self.items):
                if fits(len(x)):
                    at = np.arange(len(x) - span + 1)
                    keys.append(_keys(x, at, picks, salt))
                    item.append(np.full(len(at), i))
                    place.append(at)
            k, i, p = np.concatenate(keys), np.concatenate(item), np.concatenate(place)
            o = np.argsort(k, kind="stable")
            self.tables.append((picks, span, salt, k[o], i[o], p[o]))

    def hits(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, start of the item in the text) of every hash that is in both."""
        found: set[tuple[int, int]] = set()
        known = ids > 0
        for picks, span, salt, keys, item, place in self.tables:
            n = len(ids) - span + 1
            if n <= 0 or not len(keys):
                continue
            ok = known[picks[0] : picks[0] + n].copy()
            for p in picks[1:]:
                ok &= known[p : p + n]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h = _keys(ids, at, picks, salt)
            lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
            for j in np.flatnonzero(hi > lo):
                found |= {(int(item[x]), int(at[j] - place[x])) for x in range(lo[j], hi[j])}
        return found


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """Start and end of the longest stretch with at most one false for every ``MISMATCH`` true, trimmed to true ends."""
    s = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISMATCH))))
    # The earliest prefix sum that isn't above each later one; running minima fall, so it is found by search.
    first = np.searchsorted(-np.minimum.accumulate(s), -s)
    end = int(np.argmax(np.arange(len(s)) - first))
    hit = np.flatnonzero(same[first[end] : end])
    return (int(first[end] + hit[0]), int(first[end] + hit[-1] + 1)) if len(hit) else (0, 0)


def overlaps(index: Index, ids: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the text, start in the item, length, equal words), the best of each item that passes."""
    best: dict[int, tuple[int, int, int, int, int]] = {}
    for i, start in sorted(index.hits(ids)):
        item = index.items[i]
        a, b = max(0, -start), min(len(item), len(ids) - start)
        same = ids[start + a : start + b] == item[a:b]
        x, y = best_stretch(same)
        n, equal = y - x, int(same[x:y].sum())
        if n >= min(LEAST_WORDS, len(item)) and equal >= LEAST_SHARE * n and (i not in best or equal > best[i][4]):
            best[i] = (i, start + a + x, a + x, n, equal)
    return list(best.values())


class Coder(dict):
    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        w = normal(word)
        code = self.vocabulary.get(w, 0) if w else -1
        if len(word) < 64:
            self[word] = code
        return code


_OUT = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long, item_words long"


def _word_ids(text: str | None, coder: Coder) -> np.ndarray:
    w = (text or "").lower().split()
    ids = np.fromiter(map(coder.__getitem__, w), np.int32, len(w))
    if len(coder) > MEMORY_WORDS:
        coder.clear()
    return ids[ids >= 0]


def _block(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        coder = Coder(index.vocabulary)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                for i, at, of, n, equal in overlaps(index, _word_ids(text, coder)):
                    out.append((doc, index.item_ids[i], at, of, n, equal, len(index.items[i])))
            columns = [c.split()[0] for c in _OUT.split(", ")]
            got = pd.DataFrame(out, columns=columns)
            yield got.astype({c: "Int64" for c in columns})

    return docs.mapInPandas(run, _OUT)


def _clean(spark: SparkSession, items: list[tuple[int, str]]):
    """A column function: whether a text holds no passage of the items."""
    shared = spark.sparkContext.broadcast(Index(items))

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        coder = Coder(index.vocabulary)
        for texts in batches:
            yield pd.Series([not overlaps(index, _word_ids(t, coder)) for t in texts], dtype=bool)

    return clean


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(is_word_count(F.col("text")))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield sorted(((r.item_id, r.text) for r in items.where(block == k).collect()), key=str)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)`` and item of ``benchmark(item_id, text)`` that overlap.

    ``doc_word`` and ``item_word`` say where, in words; ``n_words`` and ``n_equal`` how long and how alike it is.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return reduce(DataFrame.union, [_block(docs, items) for items in _blocks(benchmark)])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own texts hold no passage of the benchmark, all columns as they were; decided row by row, whatever their ids."""
    for items in _blocks(benchmark):
        docs = docs.where(_clean(docs.sparkSession, items)("text"))
    return docs
