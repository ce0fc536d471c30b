"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, verified links, components.

A fingerprint has eight positional bytes. Two of them within ``bits`` (4) differing bits share at least four positional
bytes, hence at least three of the first seven. The index therefore posts each distinct fingerprint under the 35
triples of its first seven positional bytes; in a posting list the shared bytes of a pair are tallied, pairs below four
are dropped and the others verified by their differing bits.

Copies are one fingerprint. A posting list streams through one task: up to ``SHORT`` members their pairs are compared by
shifts, up to ``LIST`` members a spanning forest of the verified links is grown row by row, and of longer lists nothing is
held: their members go to a second index instead, by midpoint. Fingerprints are within four bits of each other exactly if
some value is within two bits of both, so each posts the 2,081 values within two bits of itself, and all that meet at
a value link to the smallest there. That adds rows in proportion to the members, never their pairs.

Cases: null and empty texts have fingerprint zero and link like any other; a null doc_id is kept and never names a
component unless all its members are null; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

SHINGLE, BITS, LEAST_SHARED = 4, 4, 4
SHORT, LIST = 24, 2048
TRIPLES = list(combinations(range(7), 3))
#: For each set of shared positions (as bits) the first triple that it holds.
_FIRST = np.array([next((i for i, t in enumerate(TRIPLES) if all(m >> p & 1 for p in t)), -1) for m in range(256)], np.int64)
_WEIGHT = (1 << np.arange(8)).astype(np.uint8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text over XXH64 (seed 42) of its word shingles; A-Z are lower-cased, other letters stay."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: str) -> DataFrame:
    """``(doc_id, fp)`` for every row, fp the fingerprint as a signed 64-bit integer; ``more`` names long columns to keep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = np.array([fingerprint(t, shingle) for t in pdf.text], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "fp": f} | {c: pdf[c] for c in more})

    layout = "doc_id long, fp long" + "".join(f", {c} long" for c in more)
    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInPandas(run, layout)


def _shared(x: np.ndarray) -> np.ndarray:
    """For each XOR of two fingerprints the positions of equal bytes, as bits."""
    return ((x.view(np.uint8).reshape(-1, 8) == 0) * _WEIGHT).sum(1, dtype=np.uint8)


def _linked(x: np.ndarray, bits: int) -> np.ndarray:
    return (np.bitwise_count(_shared(x)) >= LEAST_SHARED) & (np.bitwise_count(x) <= bits)


def _forest(fp: np.ndarray, bits: int) -> list[tuple[np.uint64, np.uint64]]:
    """Links that connect what is connected within one posting list."""
    left, out = np.arange(len(fp)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            hit = _linked(fp[left] ^ fp[i], bits)
            out += [(fp[i], fp[j]) for j in left[hit]]
            front += left[hit].tolist()
            left = left[~hit]
    return out


def _index(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Streams (key, fp) sorted by key; yields links (a, b), and (fp, null) for members of lists beyond ``LIST``."""
    key, held, long_ = None, [], False

    def close(lists: list[np.ndarray], key: int) -> list:
        fp = np.concatenate(lists) if lists else np.empty(0, np.uint64)
        return _forest(fp, bits) if len(fp) > 1 else []

    for pdf in batches:
        k, fp = pdf.key.to_numpy(), pdf.fp.to_numpy().astype(np.uint64)
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(cut, len(k)))
        links: list = []
        apart: list[np.ndarray] = []
        inner = np.ones(len(cut), bool)
        # The first and last list of a batch may go on in its neighbours and are held.
        for g in dict.fromkeys((0, len(cut) - 1)):
            inner[g] = False
            own = fp[cut[g] : cut[g] + size[g]]
            if k[cut[g]] != key:
                if not long_:
                    links += close(held, key)
                key, held, long_ = k[cut[g]], [], False
            held.append(own)
            if not long_ and sum(map(len, held)) > LIST:
                apart.append(np.concatenate(held))
                held, long_ = [], True
            elif long_:
                apart += held
                held = []
        for g in np.flatnonzero(inner & (size > SHORT)):
            own = fp[cut[g] : cut[g] + size[g]]
            if size[g] > LIST:
                apart.append(own)
            else:
                links += _forest(own, bits)
        short = np.repeat(inner & (size <= SHORT) & (size > 1), size)
        f, kk = fp[short], k[short]
        found = [np.array(links, np.uint64).reshape(-1, 2)]
        for d in range(1, SHORT):
            same = np.flatnonzero(kk[d:] == kk[:-d]) if d < len(kk) else np.empty(0, np.int64)
            if not len(same):
                break
            a, b = f[same], f[same + d]
            x = a ^ b
            shared = _shared(x)
            # A pair meets in several lists; only the first of them reports it.
            ok = (np.bitwise_count(shared) >= LEAST_SHARED) & (np.bitwise_count(x) <= bits) & (_FIRST[shared] == kk[same] >> 24)
            found.append(np.stack([a[ok], b[ok]], 1))
        ab = np.concatenate(found).astype(np.int64)
        yield pd.DataFrame({"a": ab[:, 0], "b": pd.array(ab[:, 1], "Int64")})
        if apart:
            m = np.concatenate(apart).astype(np.int64)
            yield pd.DataFrame({"a": m, "b": pd.array([pd.NA] * len(m), "Int64")})
    if key is not None and not long_:
        ab = np.array(close(held, key), np.uint64).reshape(-1, 2).astype(np.int64)
        yield pd.DataFrame({"a": ab[:, 0], "b": pd.array(ab[:, 1], "Int64")})


def links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect exactly those within ``bits`` bits."""
    if bits != 4:
        raise ValueError("the index is laid out for 4 differing bits")
    byte = [f"(shiftrightunsigned(fp, {8 * p}) & 255)" for p in range(8)]
    keys = [f"{i << 24}L + {byte[a]} * 65536L + {byte[b]} * 256L + {byte[c]}" for i, (a, b, c) in enumerate(TRIPLES)]
    posted = classes.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    posted = posted.repartition(n, "key").sortWithinPartitions("key", "fp").select("key", "fp")
    found = written(posted.mapInPandas(lambda it: _index(it, bits), "a long, b long"), "links")
    one, two = [1 << i for i in range(64)], [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    masks = np.array([0, *one, *two], np.uint64).astype(np.int64)

    def midpoints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                fp = pdf.a.to_numpy()[i : i + 256]
                yield pd.DataFrame({"a": np.repeat(fp, len(masks)), "mid": (fp[:, None] ^ masks).ravel()})

    members = written(found.where("b is null").select("a").distinct(), "members")
    if members.isEmpty():
        return found.where("b is not null")
    mids = members.mapInPandas(midpoints, "a long, mid long")
    least = mids.groupBy("mid").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most").select("mid", "b")
    met = mids.join(least, "mid").where("a <> b").select("a", "b").distinct()
    return found.where("b is not null").union(met)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach, itself included.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    found = classed(prints, bits)
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def classed(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``(fp, root, component_id)`` for each distinct fingerprint of ``prints(doc_id, fp)``."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), bits)).withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return classes.join(least, "root").select("fp", "root", "component_id")
