"""Repeated passages: every byte that a string of ``LENGTH`` (400) bytes covers which also starts anywhere else.

A suffix array over range-partitioned buckets. Sorting a suffix of 400 bytes at every byte would shuffle 400 times the input, so
suffixes travel in blocks. Anchors are content-defined: each window of ``LENGTH`` bytes has as its anchor the leftmost of
its ``SEED``-byte seeds with the least hash; consecutive windows with one anchor are a block, which is about two hundred suffixes
in 600 bytes. Equal windows have equal seeds at equal places, so only suffixes of blocks whose anchors' seeds are equal can be equal.

1. Anchors are emitted with a hash of the seed and one of the whole block; seeds that occur once are out.
2. Blocks that are equal as a whole are repeated in all their suffixes. One of each stands for its class.
3. Splitters that Spark samples range-partition the classes by the leading bytes of the suffix at their anchor; within a bucket
   a multikey quicksort with eight-byte characters sorts the suffixes of all blocks by their bytes, and neighbours that tie down
   to ``LENGTH`` bytes are repeats. Splitters never part equal seeds, so no equal pair lies across a boundary.
   Seeds with more than ``CROWD`` classes would make a bucket too large; hashes of their suffixes are
   counted over all executors instead, which splits them evenly and finds the same.
4. Runs of repeated windows are joined to their texts, merged and cut out.

Blocks are told equal by two 64-bit hashes, texts are addressed by 128 bits of hash; a text that several rows have is repeated in
all its windows. Joins on seeds, blocks and texts are salted, as a passage or copy that is everywhere makes one key of them.

Cases: null texts are empty; texts below ``LENGTH`` bytes have no windows and stay; repeated rows repeat each other;
very long texts are cut into overlapping pieces for counting, not for the result; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

LENGTH, SEED = 400, 32
SEEDS = LENGTH - SEED + 1
CROWD = 8_000
#: Bytes that are hashed at once.
PIECE = 1 << 20
_FULL = np.iinfo(np.uint64).max


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    base = 0x9E3779B97F4A7C15
    power = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))))
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), power(base), power(pow(base, -1, 1 << 64))


class Hasher:
    """Hashes of any substrings of up to ``n`` bytes by prefix sums of a polynomial modulo 2**64."""

    size = 0

    def __init__(self, data: np.ndarray):
        if len(data) + 1 > Hasher.size:
            Hasher.size = max(2 * PIECE, len(data) + 1)
            Hasher.letter, Hasher.power, Hasher.inverse = _tables(Hasher.size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(Hasher.letter[data] * Hasher.power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Hasher.inverse[start])

    def all(self, length: int) -> np.ndarray:
        return mixed((self.sums[length:] - self.sums[:-length]) * Hasher.inverse[: len(self.sums) - length])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def sliding(x: np.ndarray, w: int, of) -> np.ndarray:
    """``of`` (np.minimum or np.maximum) over every ``w`` consecutive values."""
    n, rows = len(x), -(-len(x) // w)
    y = np.full(rows * w, _FULL if of is np.minimum else 0, np.uint64)
    y[:n] = x
    y = y.reshape(rows, w)
    ahead = of.accumulate(y, 1).ravel()
    behind = of.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return of(behind[: n - w + 1], ahead[w - 1 : n])


def blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Over texts of ``LENGTH`` bytes or more: arrays text, first window, windows, anchor - first window, seed hash, block hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    hashed = Hasher(data)
    seeds = hashed.all(SEED)
    least = sliding(seeds, SEEDS, np.minimum)  # by window
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    valid = ends[text] - np.arange(len(least)) >= LENGTH
    # Places whose seed is the least of some window that they are in.
    padded = np.concatenate((np.zeros(SEEDS - 1, np.uint64), np.where(valid, least, 0), np.zeros(SEEDS - 1, np.uint64)))
    places = np.flatnonzero(seeds == sliding(padded, SEEDS, np.maximum))
    cut = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1]))))
    last = np.concatenate((cut[1:], [len(least)])) - 1
    cut, last = cut[valid[cut]], last[valid[cut]]
    values, which = np.unique(seeds[places], return_inverse=True)
    n = np.int64(len(seeds) + 1)
    order = np.sort(which * n + places)
    of = np.searchsorted(values, least[cut]) * n
    i0, i1 = np.searchsorted(order, of + cut), np.searchsorted(order, of + last)
    count = i1 - i0 + 1  # a run of equal minima passes all occurrences before its last window, and takes the next
    run = np.repeat(np.arange(len(cut)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    anchor = order[i0[run] + nth] - of[run]
    first = np.where(nth == 0, cut[run], np.concatenate(([0], anchor[:-1])) + 1)
    end = np.minimum(anchor, last[run])
    keep = end >= first
    run, anchor, first, end = run[keep], anchor[keep], first[keep], end[keep]
    return text[first], first - starts[text[first]], end - first + 1, anchor - first, seeds[anchor], hashed(first, end + LENGTH)


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of about ``PIECE`` bytes: row numbers, offsets and bytes; longer texts in pieces that share ``LENGTH - 1`` bytes."""
    rows, offsets, parts, n = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[a : a + PIECE + LENGTH - 1]
            if len(part) >= LENGTH:
                rows.append(i), offsets.append(a), parts.append(part)
                n += len(part)
            if n >= PIECE:
                yield rows, offsets, parts
                rows, offsets, parts, n = [], [], [], 0
    if rows:
        yield rows, offsets, parts


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[tuple[int, int]] = set()
    for pdf in batches:
        new = []
        for k in zip(pdf.k1, pdf.k2, strict=True):  # copies within a task say nothing new
            new.append(k not in seen)
            seen.add(k)
        pdf = pdf[new]
        k1, k2 = pdf.k1.to_numpy(), pdf.k2.to_numpy()
        for rows, offsets, parts in pieces([t.encode("utf-8", "surrogatepass") for t in pdf.text]):
            t, first, n, a, seed, block = blocks(parts)
            row, off = np.array(rows)[t], np.array(offsets)[t]
            yield pd.DataFrame({"k1": k1[row], "k2": k2[row], "s": (first + off), "n": n.astype(np.int32), "a": a.astype(np.int32), "h": _signed(seed), "c": _signed(block)})


_ANCHORS = "k1 long, k2 long, s long, n int, a int, h long, c long"


def _suffixes(raw: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes of blocks, and for each of their suffixes: block number, number within the block, place in the bytes."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    base = np.cumsum([len(x) for x in raw]) - [len(x) for x in raw]
    block = np.repeat(np.arange(len(raw)), n)
    i = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
    return data, block, i, base[block] + i


def tied(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place equals another of its group in the first ``LENGTH`` bytes.

    Multikey quicksort over eight bytes at a time, all groups in step: a group whose members differ at the present depth is
    sorted there and parts into smaller ones, one that agrees goes on to the next depth, and one of a single suffix is done.
    """
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * (7 - k))
    own = np.argsort(group, kind="stable")
    new = np.concatenate(([True], group[own][1:] != group[own][:-1]))[: len(own)]
    for depth in range(0, LENGTH, 8):
        size = np.diff(np.append(np.flatnonzero(new), len(own)))
        stay = np.repeat(size > 1, size)
        own, new = own[stay], new[stay]
        if not len(own):
            break
        x = words[at[own] + depth]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(own)))
        parts = np.logical_or.reduceat(x != np.repeat(x[first], size), first)
        if parts.any():
            which = np.repeat(parts, size)
            order = np.flatnonzero(which)
            g = np.repeat(np.arange(len(first)), size)[order]
            order = order[np.lexsort((x[order], g))]
            own[which], x[which] = own[order], x[order]
            new[1:] |= which[1:] & (x[1:] != x[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(own)))
    out = np.zeros(len(at), bool)
    out[own[np.repeat(size > 1, size)]] = True
    return out


def _runs(block: np.ndarray, i: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, first and last window of each run of hits."""
    b, i = block[hit], i[hit]
    new = np.concatenate(([True], (b[1:] != b[:-1]) | (i[1:] != i[:-1] + 1)))[: len(b)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(b))[: len(first)] - 1  # no hits, no runs
    return b[first], i[first], i[last]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams blocks sorted by seed; runs of suffixes that are equal to others of their seed."""

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        data, block, i, at = _suffixes(list(pdf.raw), pdf.n.to_numpy())
        # Suffixes can be equal where seed and offset to the anchor are.
        seed = np.unique(pdf.h.to_numpy(), return_inverse=True)[1]
        hit = tied(data, at, seed[block] * LENGTH + pdf.a.to_numpy()[block] - i)
        b, x, y = _runs(block, i, hit)
        s = pdf.s.to_numpy()[b]
        return pd.DataFrame({"k1": pdf.k1.to_numpy()[b], "k2": pdf.k2.to_numpy()[b], "start": s + x, "end": s + y + LENGTH})

    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size < 4000:
            continue
        whole = pd.concat(held, ignore_index=True)
        going = (whole.h == whole.h.iloc[-1]).to_numpy()
        held, size = [whole[going]], int(going.sum())
        if not going.all():
            yield found(whole[~going].reset_index(drop=True))
    if size:
        yield found(pd.concat(held, ignore_index=True))


_SPANS = "k1 long, k2 long, start long, end long"


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def repeated_spans(texts: DataFrame, anchors: DataFrame, shared: DataFrame) -> DataFrame:
    """Runs of repeated windows ``(k1, k2, start, end)`` in bytes. ``shared``: classes of blocks ``(h, c, n_blocks, rep)``
    whose seeds recur; ``texts(k1, k2, raw)``: compressed texts, each once."""
    whole = spread_join(anchors, shared.where("n_blocks > 1").select("h", "c"), ["h", "c"])
    whole = whole.select("k1", "k2", F.col("s").alias("start"), (F.col("s") + F.col("n") - 1 + LENGTH).alias("end"))
    seeds = shared.groupBy("h").agg(F.count("*").alias("classes")).where("classes > 1")
    reps = spread_join(shared.select("h", "rep"), seeds, ["h"]).select("rep.k1", "rep.k2", "rep.s", "rep.n", "rep.a", "h", "classes")
    wanted = reps.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "n", "a", "h", "classes")).alias("blocks"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                out = []
                for k1, k2, raw, own in zip(*(pdf[c].iloc[i : i + 500] for c in ("k1", "k2", "raw", "blocks")), strict=True):
                    data = unzip.decompress(raw)
                    for b in own:
                        at = b["s"] + b["a"]
                        lead = int.from_bytes(data[at : at + 7], "big")
                        out.append((k1, k2, b["s"], b["n"], b["a"], b["h"], b["classes"], lead, data[b["s"] : b["s"] + b["n"] - 1 + LENGTH]))
                yield pd.DataFrame(out, columns=["k1", "k2", "s", "n", "a", "h", "classes", "lead", "raw"])

    layout = "k1 long, k2 long, s long, n int, a int, h long, classes long, lead long, raw binary"
    cutout = written(texts.join(wanted, ["k1", "k2"]).mapInPandas(cut, layout), "blocks")
    n = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = cutout.where(F.col("classes") <= CROWD).drop("classes")
    parts = few.repartitionByRange(n, "lead", "h").sortWithinPartitions("lead", "h").mapInPandas(_compare, _SPANS)
    found = whole.union(parts)
    crowd = cutout.where(F.col("classes") > CROWD).drop("classes", "lead")
    if crowd.isEmpty():
        return found

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                p = pdf.iloc[i : i + 500]
                data, b, w, at = _suffixes(list(p.raw), p.n.to_numpy())
                d = (p.a.to_numpy()[b] - w).astype(np.uint64)
                key = mixed(Hasher(data)(at, at + LENGTH) ^ mixed(p.h.to_numpy()[b].view(np.uint64) + d * np.uint64(0x9E3779B97F4A7C15)))
                s = p.s.to_numpy()[b] + w
                yield pd.DataFrame({"k1": p.k1.to_numpy()[b], "k2": p.k2.to_numpy()[b], "start": s, "end": s + LENGTH, "key": _signed(key)})

    each = written(crowd.mapInPandas(hashes, _SPANS + ", key long"), "windows")
    twice = each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    return found.union(each.join(twice, "key").select("k1", "k2", "start", "end"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs(doc_id, text)``."""
    rows = keyed(docs)
    anchors = written(rows.select("k1", "k2", "text").mapInPandas(_anchors, _ANCHORS), "anchors")
    twice = anchors.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    anchors = written(spread_join(anchors, twice, ["h"]), "anchors")
    shared = anchors.groupBy("h", "c").agg(F.count("*").alias("n_blocks"), F.min(F.struct("k1", "k2", "s", "n", "a")).alias("rep"))
    shared = written(shared, "classes")
    touched = anchors.select("k1", "k2").distinct()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        seen: set[tuple[int, int]] = set()
        for pdf in batches:
            long_ = [len(t) >= LENGTH // 4 and (k not in seen, seen.add(k))[0] for t, k in zip(pdf.text, zip(pdf.k1, pdf.k2, strict=True), strict=True)]
            own = pdf[long_]
            yield pd.DataFrame({"k1": own.k1, "k2": own.k2, "raw": [press.compress(t.encode("utf-8", "surrogatepass")) for t in own.text]})

    packed = rows.select("k1", "k2", "text").mapInPandas(pack, "k1 long, k2 long, raw binary")
    texts = written(packed.join(touched, ["k1", "k2"]).dropDuplicates(["k1", "k2"]), "texts")
    spans = repeated_spans(texts, anchors, shared).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for k1, k2, raw, own in zip(pdf.k1, pdf.k2, pdf.raw, pdf.spans, strict=True):
                data, at, left = unzip.decompress(raw), 0, hashlib.sha256()
                cut = merged((s["start"], s["end"]) for s in own)
                for a, b in cut:
                    left.update(data[at:a])
                    at = b
                left.update(data[at:])
                out.append((k1, k2, sum(b - a for a, b in cut), len(cut), left.hexdigest()))
            yield pd.DataFrame(out, columns=["k1", "k2", "r", "m", "left"])

    cut = written(texts.join(spans, ["k1", "k2"]).mapInPandas(kept, "k1 long, k2 long, r long, m long, left string"), "cut")
    size = F.octet_length("text").cast("long")
    each = rows.select("doc_id", "k1", "k2", size.alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    each = spread_join(each, cut.join(copies, ["k1", "k2"], "full"), ["k1", "k2"], "left")
    all_ = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    pick = lambda whole, part, none: F.when(all_, whole).when(F.col("r").isNotNull(), part).otherwise(none)
    return each.select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("r"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("m"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(hashlib.sha256().hexdigest()), F.col("left"), F.col("own")).alias("kept_sha256"),
    )
