"""Token-id output: raw id payloads in shards, a minimal perfect hash index over document keys.

``write_shards`` sends each range of keys to one task, which encodes its texts and appends their ids to one payload
file (little-endian unsigned 16-bit, or 32-bit for vocabularies beyond that). The table ``records`` names the file,
place and length of each record. ``build_index`` deals the keys to hash buckets of bounded size; a bucket becomes one
file with a hash-and-displace minimal perfect hash, whose slot holds a 32-bit fingerprint of the key and the place of its
records. ``lookup`` finds any keys with two array reads each; a key that was never written fails the fingerprint.

Files go through ``pyarrow.fs`` to the shared folder under names with a random part; only those that a committed task
has reported are used, so repeated and speculative tasks do no harm.

Cases: null texts are empty and have the end id alone; a null key is a key of its own, ordered first; rows that repeat
a key lie side by side, are one index entry with a count and are returned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, written

#: Keys of one index bucket on average.
BUCKET_KEYS = 20_000
#: Entries of a task's word memory.
MEMORY_WORDS = 400_000
_TAIL = re.compile(r"([^\W\d_]+)([.,;:!?#*$%&]+)")
_FAR = re.compile("[^\x00-ɏ]|İ")
#: Bytes that aren't printable stand in a byte-level vocabulary as characters from 256 on, in order.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def put(uri: str, data: bytes) -> None:
    fs, path = store(uri)
    with fs.open_output_stream(path) as f:
        f.write(data)


class WordEncoder(dict):
    """Memory of word -> id bytes for a tokenizer that drops white space: ids of a text are those of its words in turn.

    Words end at spaces and line feeds only; other white space inside them is left to the tokenizer.
    """

    def __init__(self, path: str, code: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.code = Tokenizer.from_file(path), code

    def __missing__(self, word: str) -> bytes:
        if (m := _TAIL.fullmatch(word)) and m[1][-1] <= "ɏ":
            found = self[m[1]] + self[m[2]]  # letters and a run of marks are pieces of their own
        elif word.isalpha() and word.islower() and (word.isascii() or not _FAR.search(word)):
            # One piece of plain letters, which the model sees as characters that stand for its bytes.
            piece = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
            found = np.array([t.id for t in self.tokenizer.model.tokenize(piece)], self.code).tobytes()
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.code).tobytes()
        if len(word) < 64:
            self[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        # Added tokens, all of which begin with <|, are matched in the text as it is, so its case stays where they may be.
        # Elsewhere in such texts lower() maps letter by letter and nothing composes.
        if "<|" not in text and (text.isascii() or not _FAR.search(text)):
            text = text.lower()
        if len(self) > MEMORY_WORDS:
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


#: The encoder that this Python process used last: later tasks of a reused worker find its words there.
_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def encoder_of(path: str, code: str) -> WordEncoder:
    if (path, code) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, code] = WordEncoder(path, code)
    return _ENCODERS[path, code]


def id_code(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_shards(docs: DataFrame, tokenizer: str, to: str, end_id: int = 1, shards: int | None = None, vocabulary: int = 1 << 16) -> DataFrame:
    """Writes the ids of ``docs(doc_id, text)`` in ascending doc_id order below ``to``.

    Returns ``records(doc_id, shard, file, rec, start, n)``, start and n in ids within the file. Texts that share a key
    are ordered by text. ``vocabulary`` bounds the ids and so fixes their width.
    """
    spark, code = docs.sparkSession, id_code(vocabulary)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, path = store(to)
    fs.create_dir(path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end, name, at, rec, out = None, np.array([end_id], code).tobytes(), None, 0, 0, None
        width = len(end)
        try:
            for pdf in batches:
                encoder = encoder or encoder_of(tokenizer, code)
                if out is None:
                    name = f"shard-{uuid.uuid4().hex}.bin"
                    fs_, base = store(to)
                    out = fs_.open_output_stream(f"{base}/{name}")
                ids = [encoder.ids(t) + end for t in pdf.text]
                sizes = np.array([len(x) // width for x in ids], np.int64)
                out.write(b"".join(ids))
                starts = at + np.cumsum(sizes) - sizes
                yield pd.DataFrame({"doc_id": pdf.doc_id, "file": name, "rec": np.arange(rec, rec + len(ids)), "start": starts, "n": sizes})
                at, rec = at + int(sizes.sum()), rec + len(ids)
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    records = rows.mapInPandas(write, "doc_id long, file string, rec long, start long, n long")
    records = written(records, "records")
    files = shard_bases(records)
    return records.join(F.broadcast(files.select("file", "shard")) if n <= 100_000 else files.select("file", "shard"), "file")


def shard_bases(records: DataFrame) -> DataFrame:
    """``(file, shard, base)``: the number of each file in key order and the ids of all files before it. One row a file."""
    w = Window.orderBy(F.col("least").asc_nulls_first(), "file")
    files = records.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n").alias("ids"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    files = files.withColumn("least", F.when(F.col("has_null"), F.lit(None)).otherwise(F.col("least")))
    return files.select("file", (F.row_number().over(w) - 1).alias("shard"), (F.sum("ids").over(w) - F.col("ids")).alias("base"))


def _hash(key: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(key, seed)


def _mixed(h: np.ndarray, seed) -> np.ndarray:
    x = h ^ (np.uint64(0x9E3779B97F4A7C15) * np.asarray(seed, np.uint64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace over distinct 64-bit hashes: a seed for each small group, a slot below ``len(h)`` for each hash."""
    n = len(h)
    groups = max(1, n // 3)
    g = (_mixed(h, 1) % np.uint64(groups)).astype(np.int64)
    order, count = np.argsort(g, kind="stable"), np.bincount(g, minlength=groups)
    first = np.cumsum(count) - count
    seeds, slots, used = np.zeros(groups, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    for k in np.argsort(-count, kind="stable"):
        if not count[k]:
            break
        own = order[first[k] : first[k] + count[k]]
        seed, tries = 2, 64
        while True:
            seeds_ = np.arange(seed, seed + tries, dtype=np.uint64)
            at = (_mixed(h[own][None, :], seeds_[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~used[at].any(1)
            if len(own) > 1:
                s = np.sort(at, 1)
                good &= (s[:, 1:] != s[:, :-1]).all(1)
            hit = np.flatnonzero(good)
            if len(hit):
                seeds[k], slots[own] = seed + hit[0], at[hit[0]]
                used[at[hit[0]]] = True
                break
            seed, tries = seed + tries, min(4096, tries * 2)
    return seeds, slots


_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("n", "<u8"), ("count", "<u4")])


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64(F.lit(11), F.col("key")), F.lit(buckets)).cast("int")


def key_of():
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def build_index(records: DataFrame, to: str) -> tuple[DataFrame, int]:
    """One index file a bucket below ``to``; returns ``(bucket, index)`` file names and the number of buckets."""
    keys = records.groupBy("doc_id").agg(F.min(F.struct("start", "shard")).alias("at"), F.sum("n").alias("n"), F.count("*").alias("count"))
    keys = written(keys.select(key_of().alias("key"), "at.start", "at.shard", "n", "count"), "keys")
    buckets = max(1, -(-keys.count() // BUCKET_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.array([_hash(k, 3) for k in pdf.key], np.uint64)
        if len(np.unique(h)) < len(h):
            raise ValueError("two keys of a bucket share a 64-bit hash")
        seeds, slots = perfect_hash(h)
        table = np.zeros(len(h), _SLOT)
        table["print"][slots] = [_hash(k, 5) & 0xFFFFFFFF for k in pdf.key]
        for c in ("shard", "start", "n", "count"):
            table[c][slots] = pdf[c]
        name = f"index-{uuid.uuid4().hex}.mph"
        put(f"{to}/{name}", np.array([len(seeds), len(table)], "<u8").tobytes() + seeds.astype("<u4").tobytes() + table.tobytes())
        return pd.DataFrame({"bucket": [pdf.bucket.iloc[0]], "index": [name]})

    made = keys.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(build, "bucket int, index string")
    return written(made, "index"), buckets


def lookup(keys: DataFrame, index: DataFrame, buckets: int, to: str) -> DataFrame:
    """``keys(key)`` with ``shard, start, n, count`` from the index; keys that it doesn't hold give no row.

    Keys of a bucket are read through once; each costs one seed and one slot.
    """

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, path = store(f"{to}/{pdf['index'].iloc[0]}")
        with fs.open_input_file(path) as f:
            raw = f.read()
        groups, n = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        seeds, table = np.frombuffer(raw, "<u4", groups, 16), np.frombuffer(raw, _SLOT, n, 16 + 4 * groups)
        h = np.array([_hash(k, 3) for k in pdf.key], np.uint64)
        slot = table[(_mixed(h, seeds[(_mixed(h, 1) % np.uint64(groups)).astype(np.int64)].astype(np.uint64)) % np.uint64(n)).astype(np.int64)]
        ok = slot["print"] == np.array([_hash(k, 5) & 0xFFFFFFFF for k in pdf.key], np.uint32)
        out = pd.DataFrame({c: slot[c].astype(np.int64) for c in ("shard", "start", "n", "count")})
        return out.assign(key=pdf.key.to_numpy())[ok]

    asked = keys.select("key").distinct().withColumn("bucket", bucket_of(buckets)).join(index, "bucket")
    return asked.groupBy("bucket").applyInPandas(find, "key string, shard long, start long, n long, count long")


def read_records(found: DataFrame, records: DataFrame, to: str, vocabulary: int = 1 << 16) -> DataFrame:
    """The records of looked-up keys, from the payload files: ``key, start, n_tokens, ids_crc32, shard``.

    start counts the ids of all files before, crc32 runs over the ids as little-endian unsigned 32-bit integers.
    """
    code, width = id_code(vocabulary), 2 if vocabulary <= 1 << 16 else 4
    bases = shard_bases(records)
    # An entry with a count is a run of rows that share the key; where it is cut is in the records' table.
    runs = records.select(key_of().alias("key"), F.col("start").alias("s"), F.col("n").alias("n_ids"))
    one = found.where("count = 1").select("key", "shard", F.col("start").alias("s"), F.col("n").alias("n_ids"))
    more = found.where("count > 1").join(runs, "key").where("s >= start and s < start + n").select(*one.columns)
    asked = one.union(more).join(F.broadcast(bases), "shard")
    asked = asked.repartition("file").sortWithinPartitions("file", "s")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, f = None, None
        for pdf in batches:
            sums = []
            for file, s, n in zip(pdf.file, pdf.s, pdf.n_ids, strict=True):
                if file != name:
                    fs, path = store(f"{to}/{file}")
                    name, f = file, fs.open_input_file(path)
                f.seek(s * width)
                sums.append(zlib.crc32(np.frombuffer(f.read(n * width), code).astype("<u4").tobytes()))
            yield pd.DataFrame({"key": pdf.key, "start": pdf.base + pdf.s, "n_tokens": pdf.n_ids, "ids_crc32": np.array(sums, np.int64), "shard": pdf["shard"]})

    return asked.mapInPandas(read, "key string, start long, n_tokens long, ids_crc32 long, shard long")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 1, vocabulary: int = 1 << 16) -> DataFrame:
    """Writes shards and index for all of ``docs``, then reads every document back by key."""
    spark: SparkSession = docs.sparkSession
    to = fresh_dir(spark, "tokens")
    records = write_shards(docs, tokenizer, to, end_id, vocabulary=vocabulary)
    index, buckets = build_index(records, to)
    found = lookup(records.select(key_of().alias("key")), index, buckets, to)
    rows = read_records(found, records, to, vocabulary)
    return rows.select(F.when(F.col("key") != "null", F.col("key").cast("long")).alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard")
