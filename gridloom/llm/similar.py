"""SimHash near-duplicates by similarity of word shingles: wide fingerprints, the positional index, exact verification.

Texts whose sets of ``shingle`` (5) word shingles have a Jaccard similarity of ``least`` (0.8) or more are linked. That far apart
64 bits would not tell them from others, so fingerprints here have 1,024 bits in 128 positional bytes. Linked texts differ in
15 of 100 bits or fewer on average, so whole bytes stay equal; the inverted index posts each distinct fingerprint under 128
triples of its positional bytes. All pairs that meet in a posting list and have few enough differing bits are candidates, and
each link is then verified on the shingles of the two texts, so no unlike texts are ever joined. What the index misses is measured (README).

Copies, and texts with one fingerprint, are one class. Lists whose pairs are many (above ``DENSE`` for each member, or lists
beyond ``LIST``) hold a crowd of near copies: each member is compared with the closest of its lists' smallest members. Lists that links
haven't made one group then are taken apart into finer ones, under one more triple each, for pairs of different groups alone. Of lists
that hold several groups even then all pairs of different groups are compared, in blocks, so no list's length or density loses a pair.
Candidates are verified closest first, a few for each class in a round; pairs that other links have joined meanwhile are dropped, so a crowd
costs about one comparison a class.

Cases: texts without words are one class; null ids are kept and only stand for a group that has no other; repeated rows give
one row; ties go to the smallest id, then to the least hash of the text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, spread_join, written

SHINGLE, LEAST = 5, 0.8
LANES = 16  # 64-bit lanes of a fingerprint
BYTES = 8 * LANES
#: Differing bits beyond which a pair isn't verified: three standard deviations above what is expected at ``LEAST``.
FAR = 190
#: The same for the first lane, by which pairs within a list are told.
FAR_LANE = 20
#: Members of a list that are compared with each other at once, close pairs for each member, finer lists for each member of a crowd.
LIST, DENSE, FINER = 2048, 1, 16
#: Members of a block, where all pairs of a list are compared.
BLOCK = 4096
#: Links that one task contracts.
LINKS = 1_000_000
MEMORY_WORDS = 500_000
_EVEN = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)
#: Positional bytes of each key; no two keys share more than one of them.
TRIPLES = np.array([(j, (j + 37) % BYTES, (j + 83) % BYTES) for j in range(BYTES)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Memory of word -> hash."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(word) < 64:
            self[word] = h
        return h


def shingles(text: str | None, memory: Words, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; of fewer words that of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(memory) > MEMORY_WORDS:
        memory.clear()
    w = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * _EVEN[i]
        h ^= h >> np.uint64(31)
    return np.unique(_mixed(h))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """``LANES`` 64-bit lanes from shingle hashes: a bit is 1 if it is set in over half of the hashes' expansions."""
    ones = np.zeros(64 * LANES, np.int64)
    for i in range(0, len(h), 1000):
        x = _mixed(h[i : i + 1000, None] * _EVEN[None, :LANES])
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, s_text, id, fp)`` of ``docs(doc_id, s_text, text)``: the class of each text and its fingerprint, an array of longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Words()
        for pdf in batches:
            f = [fingerprint(shingles(t, memory, shingle)) for t in pdf.text]
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in f], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "s_text": pdf.s_text, "id": ids, "fp": [x.view(np.int64) for x in f]})

    return docs.select(F.col("doc_id").cast("long"), "s_text", "text").mapInPandas(run, "doc_id long, s_text long, id long, fp array<long>")


def _bytes(fp: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    lanes = np.ascontiguousarray(np.stack(fp.to_list()), np.int64)
    return lanes, lanes.view(np.uint8).reshape(len(lanes), BYTES)


_POSTED = "key long, id long, lane long, root long"


def _posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each class (id, fp) under all triples."""
    n = len(TRIPLES)
    for pdf in batches:
        for i in range(0, len(pdf), 1000):
            p = pdf.iloc[i : i + 1000]
            lanes, b = _bytes(p.fp)
            b = b.astype(np.int64)[:, TRIPLES]
            keys = (np.arange(n) << 24) + (b[:, :, 0] << 16) + (b[:, :, 1] << 8) + b[:, :, 2]
            ids = np.repeat(p.id.to_numpy(), n)
            yield pd.DataFrame({"key": keys.ravel(), "id": ids, "lane": np.repeat(lanes[:, 0], n), "root": ids})


def _finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members (key, id, fp, root) of crowds, each under ``FINER`` more triples."""
    step = len(TRIPLES) // FINER
    for pdf in batches:
        for i in range(0, len(pdf), 5000):
            p = pdf.iloc[i : i + 5000]
            lanes, b = _bytes(p.fp)
            key = p.key.to_numpy()
            t = ((key >> 24)[:, None] + 1 + step * np.arange(FINER)) % len(TRIPLES)
            own = b[np.arange(len(p))[:, None, None], TRIPLES[t]].astype(np.uint64)
            fine = _mixed(key.view(np.uint64)[:, None] * _EVEN[5] + t.astype(np.uint64))
            fine = _mixed(fine ^ (own[:, :, 0] << np.uint64(16) | own[:, :, 1] << np.uint64(8) | own[:, :, 2]))
            yield pd.DataFrame({"key": fine.ravel().view(np.int64), "id": np.repeat(p.id.to_numpy(), FINER), "lane": np.repeat(lanes[:, 0], FINER), "root": np.repeat(p.root.to_numpy(), FINER)})


def _close(ids: np.ndarray, lanes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of one list that no links join yet and that are close in their first lane, or nothing if it is a crowd."""
    a, b, n = [], [], 0
    for i in range(len(ids) - 1):
        hit = np.flatnonzero((np.bitwise_count(lanes[i + 1 :] ^ lanes[i]) <= FAR_LANE) & (roots[i + 1 :] != roots[i])) + i + 1
        n += len(hit)
        if n > DENSE * len(ids):
            return None
        a.append(np.full(len(hit), ids[i]))
        b.append(ids[hit])
    return np.concatenate(a), np.concatenate(b)


_LISTED = "key long, a long, b long, d int"


def _crowd(rows: list[np.ndarray], first: list) -> pd.DataFrame:
    """Members (key, id, star, d) of a crowd: the list's smallest member, where it is close and no links join it yet, and the differing bits."""
    key, ids, lanes, roots = rows
    d = np.bitwise_count(np.ascontiguousarray(lanes).view(np.uint64) ^ np.array([first[2]]).view(np.uint64)).astype(np.int32)
    far = (d > FAR_LANE) | (roots == first[3])
    return pd.DataFrame({"key": pd.array(key, "Int64"), "a": ids, "b": pd.arrays.IntegerArray(np.full(len(ids), first[1]), far), "d": pd.arrays.IntegerArray(d, far)})


def _compared(k: np.ndarray, ids: np.ndarray, lanes: np.ndarray, roots: np.ndarray) -> Iterator[pd.DataFrame]:
    """Pairs (null, a, b, null), a < b, of whole lists, and the members of crowds."""
    rows = [k, ids, lanes, roots]
    lanes = np.ascontiguousarray(lanes).view(np.uint64)
    cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.append(cut, len(k)))
    twos = cut[size == 2]
    twos = twos[(np.bitwise_count(lanes[twos] ^ lanes[twos + 1]) <= FAR_LANE) & (roots[twos] != roots[twos + 1])]
    a, b = [ids[twos]], [ids[twos + 1]]
    for c, m in zip(cut[size > 2], size[size > 2], strict=True):
        if (got := _close(ids[c : c + m], lanes[c : c + m], roots[c : c + m])) is None:
            yield _crowd([x[c : c + m] for x in rows], [x[c] for x in rows])
        else:
            a.append(got[0]), b.append(got[1])
    a, b = np.concatenate(a), np.concatenate(b)
    yield pd.DataFrame({"key": pd.array([pd.NA] * len(a), "Int64"), "a": np.minimum(a, b), "b": pd.array(np.maximum(a, b), "Int64"), "d": pd.array([pd.NA] * len(a), "Int32")})


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams (key, id, lane, root) sorted by key and id through ``_compared``; a list beyond ``LIST`` passes as a crowd, of which no more than that is held."""
    held, crowded = [np.empty(0, np.int64) for _ in range(4)], None
    for pdf in batches:
        held = [np.concatenate((h, pdf[c].to_numpy())) for h, c in zip(held, ("key", "id", "lane", "root"), strict=True)]
        if not len(held[0]):
            continue
        if crowded is not None:  # the list goes on that is known as a crowd
            n = int(np.searchsorted(held[0], crowded[0], "right"))
            if n:
                yield _crowd([h[:n] for h in held], crowded)
            held = [h[n:] for h in held]
            if not len(held[0]):
                continue
            crowded = None
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on
        if last:
            yield from _compared(*(h[:last] for h in held))
        held = [h[last:] for h in held]
        if len(held[0]) > LIST:
            crowded = [h[0] for h in held]
            yield _crowd(held, crowded)
            held = [h[:0] for h in held]
    if len(held[0]):
        yield from _compared(*held)


def _distance(a: str, b: str):
    """Differing bits of two fingerprints."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def _listed(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` from the posting lists, and ``(key, id, star, d)`` of the members of crowds."""
    n = max(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    got = posted.repartition(n, "key").sortWithinPartitions("key", "id").select("key", "id", "lane", "root").mapInPandas(_lists, _LISTED)
    got = written(got, "lists")
    return got.where("key is null").select("a", "b"), got.where("key is not null").select("key", F.col("a").alias("id"), F.col("b").alias("star"), "d")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b, d)``: the pairs that differ in ``FAR`` bits at most."""
    own = lambda c: classes.select(F.col("id").alias(c), F.col("fp").alias(f"f_{c}"))
    found = pairs.distinct().join(own("a"), "a").join(own("b"), "b").select("a", "b", _distance("f_a", "f_b").cast("int").alias("d"))
    return found.where(F.col("d") <= FAR)


def _stars(crowd: DataFrame) -> DataFrame:
    """``(a, b)``: each member of a crowd beside the closest of its lists' smallest members."""
    closest = crowd.where("star is not null").groupBy("id").agg(F.min(F.struct("d", "star")).alias("x"))
    return closest.select(F.col("x.star").alias("a"), F.col("id").alias("b"))


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(a, b, d)``, a < b: pairs of ``classes(id, fp)`` to verify first, and the members ``(key, id)`` of crowds, if there are any.

    Of a crowd's member there is one pair only, with the closest of the smallest members of its lists.
    """
    pairs, crowd = _listed(classes.mapInPandas(_posted, _POSTED))
    found = _near(pairs.union(_stars(crowd)), classes)
    return found, None if crowd.isEmpty() else crowd.select("key", "id")


def still_open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``(key, id, root, size)``: the members of those lists that hold several groups, and how many their list has."""
    known = members.select("key", "id")
    known = known.withColumn("root", F.col("id")) if roots is None else known.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x < y").select("key", "size")
    return written(spread_join(known, open_, ["key"]).select("key", "id", "root", "size"), "crowd")


def with_prints(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members(key, id, ..)`` with the fingerprint ``fp`` of their class, which is joined once for all lists of a class (128 and fewer)."""
    rest = [c for c in members.columns if c != "id"]
    own = members.groupBy("id").agg(F.collect_list(F.struct(*rest)).alias("lists")).join(classes.select("id", "fp"), "id")
    return own.select("id", "fp", F.inline("lists"))


def candidates_finer(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b, d)``: pairs of different groups that finer lists of the open ones have, and members of crowds beside the smallest ones."""
    pairs, crowd = _listed(with_prints(members.select("key", "id", "root"), classes).mapInPandas(_finer, _POSTED))
    return _near(pairs.union(_stars(crowd)), classes)


_BLOCKED = "a long, b long"


def _blocked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different groups between two blocks of a list, or within one, that are close."""
    pdf = pdf.sort_values("id")
    ids, roots, (lanes, _) = pdf.id.to_numpy(), pdf.root.to_numpy(), _bytes(pdf.fp)
    lanes = lanes.view(np.uint64)
    one = pdf.h.to_numpy() == pdf.i.iloc[0]
    same = pdf.i.iloc[0] == pdf.j.iloc[0]
    theirs = np.arange(len(ids)) if same else np.flatnonzero(~one)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x in np.flatnonzero(one):
        at = theirs[theirs > x] if same else theirs
        at = at[(np.bitwise_count(lanes[at, 0] ^ lanes[x, 0]) <= FAR_LANE) & (roots[at] != roots[x])]
        at = at[np.bitwise_count(lanes[at] ^ lanes[x]).sum(1, dtype=np.int64) <= FAR]
        a.append(np.full(len(at), ids[x])), b.append(ids[at])
    a, b = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def candidates_left(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b, d)``: all close pairs of different groups in the lists of ``members(key, id, root, size)``, block by block. Sizes that aren't given are counted."""
    if "size" not in members.columns:
        members = members.join(members.groupBy("key").agg(F.count("*").alias("size")), "key")
    h = F.pmod(F.xxhash64(F.lit(11), "id"), F.col("blocks")).cast("int")
    dealt = with_prints(members, classes).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("h", h)
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "id", "root", "fp", "h", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"))
    return _near(dealt.groupBy("key", "i", "j").applyInPandas(_blocked, _BLOCKED), classes)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ``texts(id, text)`` have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, known = Words(), {}

        def of(key: int, text: str | None) -> np.ndarray:
            if key not in known:
                if len(known) >= 16:
                    known.clear()
                known[key] = shingles(text, memory, shingle)
            return known[key]

        for pdf in batches:
            keep = []
            for a, b, s, t in zip(pdf.a, pdf.b, pdf.s, pdf.t, strict=True):
                x, y = of(a, s), of(b, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    own = lambda c, t: texts.select(F.col("id").alias(c), F.col("text").alias(t))
    return pairs.select("a", "b").join(own("a", "s"), "a").join(own("b", "t"), "b").select("a", "b", "s", "t").mapInPandas(run, "a long, b long")


def texts_of(docs: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, text)`` of the classes ``ids(id)``, read from the documents once. ``rows(s_id, s_text, id)`` says which texts a class has."""
    reps = rows.groupBy("id").agg(F.min(F.struct("s_id", "s_text")).alias("r")).select("id", "r.s_id", "r.s_text").join(ids.distinct(), "id")
    return written(docs.select("s_id", "s_text", "text").join(reps, ["s_id", "s_text"]).dropDuplicates(["id"]).select("id", "text"), "texts")


def linked(texts: DataFrame, found: DataFrame, roots: DataFrame | None, shingle: int, least: float) -> DataFrame | None:
    """``(id, root)`` of the groups given and those that verified candidates join; nothing if there are no links."""
    todo, most = found, 4
    # A pair is tried with its greater id, which has few: the pairs with one posting list's smallest member are many.
    order = Window.partitionBy("b").orderBy("d", "a")
    while not todo.isEmpty():
        ranked = todo.withColumn("n", F.row_number().over(order))
        ok = written(verified(ranked.where(F.col("n") <= most), texts, shingle, least), "links")
        if not ok.isEmpty():
            roots = _roots(ok if roots is None else ok.union(roots))
        rest = written(ranked.where(F.col("n") > most).select("a", "b", "d"), "pairs")
        if rest.isEmpty():
            break
        if roots is not None:
            of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r_{c}"))  # noqa: E731, B023
            rest = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(r_a, a) <> coalesce(r_b, b)")
            rest = written(rest.select("a", "b", "d"), "pairs")
        todo, most = rest, most * 16
    return roots


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links (a, b) of a task as stars: each node but the smallest of its group beside that one."""
    links = pd.concat([pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)}), *batches])
    nodes, at = np.unique(links[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"a": nodes, "b": nodes[root]})[root != np.arange(len(nodes))]


def _roots(links: DataFrame, most: int | None = None) -> DataFrame:
    """``(id, root)`` of the groups of ``links(a, b)``. Tasks of ``most`` (``LINKS``) links contract their own first; the groups of several tasks are joined in rounds."""
    tasks = max(-(-links.count() // (most or LINKS)), 1)
    stars = links.coalesce(tasks).mapInPandas(_contracted, "a long, b long")
    found = components(stars) if tasks > 1 else stars.toDF("node", "root")
    return written(found.withColumnRenamed("node", "id"), "roots")


def grouped(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``(doc_id, s_id, s_text, id, root)`` for every row of ``docs(doc_id, s_id, s_text, text)``; a group has one root."""
    rows = written(prints(docs, shingle).withColumn("s_id", _key()), "prints")
    classes = written(rows.groupBy("id").agg(F.first("fp").alias("fp")), "classes")
    rows = rows.drop("fp")
    found, members = candidates(classes)
    found = written(found, "pairs")
    ids = found.select(F.explode(F.array("a", "b")).alias("id"))
    texts = texts_of(docs, rows, ids if members is None else ids.union(members.select("id")))
    roots = linked(texts, found, None, shingle, least)
    for more in (candidates_finer, candidates_left) if members is not None else ():
        members = still_open(members, roots)
        if members.isEmpty():
            break
        roots = linked(texts, written(more(members, classes), "pairs"), roots, shingle, least)
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _key():
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``(doc_id, group_id)`` for every row of ``docs(doc_id, text)``; group_id is the smallest doc_id of its group, null if it has none."""
    rows = grouped(docs.select("doc_id", "text").withColumns({"s_id": _key(), "s_text": F.xxhash64("text")}), shingle, least)
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return rows.join(ids, "root").select("doc_id", "group_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of each group of near-duplicates of ``docs``, the one with the smallest doc_id, all columns as they were."""
    rows = docs.withColumns({"s_id": _key(), "s_text": F.xxhash64("text")})
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "s_text", "s_id")).alias("row")
    keep = grouped(rows, shingle, least).groupBy("root").agg(first).select("row.s_id", "row.s_text")
    return rows.join(keep, ["s_id", "s_text"], "left_semi").dropDuplicates(["s_id", "s_text"]).select(*docs.columns)
