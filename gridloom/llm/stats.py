"""Statistics of texts as native column expressions, and bounded samples of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5


def _drop(text, characters: str):
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs(text, ...)`` with the base statistics of each whole text as long columns.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line),
    n_repeat_words (words in five-word windows that the text has twice or more, each word once), n_lines (with a word),
    n_upper (A to Z), n_points (``.,;:!?``), n_shouts (``!``), n_digits, n_distinct (words), n_stutter (words equal to the one before).
    Null texts count as empty. Intermediate columns are named ``_s_...`` and dropped.

    The columns are computed in layers, each of which later ones read several times, so none is computed anew inside
    a lambda function.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = docs.columns
    one = docs.select(*keep, text.alias("_s_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_s_words"))
    lines = F.filter(F.split("_s_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    grams = F.expr(
        "case when size(_s_words) < 5 then array() else transform(slice(_s_words, 1, size(_s_words) - 4), "
        "(w, i) -> xxhash64(w, _s_words[i + 1], _s_words[i + 2], _s_words[i + 3], _s_words[i + 4])) end"
    )
    two = one.select(
        *keep,
        F.size("_s_words").cast("long").alias("n_words"),
        (F.length("_s_text") - _drop(F.col("_s_text"), BLANKS)).cast("long").alias("word_chars"),
        _drop(F.col("_s_text"), SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("_s_lines"),
        grams.alias("_s_grams"),
        _drop(F.col("_s_text"), "".join(map(chr, range(65, 91)))).cast("long").alias("n_upper"),
        _drop(F.col("_s_text"), ".,;:!?").cast("long").alias("n_points"),
        _drop(F.col("_s_text"), "!").cast("long").alias("n_shouts"),
        _drop(F.col("_s_text"), "0123456789").cast("long").alias("n_digits"),
        F.size(F.array_distinct("_s_words")).cast("long").alias("n_distinct"),
        F.expr("size(filter(_s_words, (w, i) -> i > 0 and w = _s_words[i - 1]))").cast("long").alias("n_stutter"),
    )
    counted = [c for c in two.columns if c not in keep and not c.startswith("_s_")]
    # Only texts that have some window twice are sorted by window.
    ordered = F.expr(
        "case when size(array_distinct(_s_grams)) < size(_s_grams) "
        "then sort_array(transform(_s_grams, (h, i) -> struct(h, i))) else array() end"
    )
    three = two.select(
        *keep,
        *counted,
        (F.size("_s_lines") - F.size(F.array_distinct("_s_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_s_lines").cast("long").alias("n_lines"),
        ordered.alias("_s_sorted"),
    )
    counted += ["n_dup_lines", "n_lines"]
    found = F.expr(
        "sort_array(transform(filter(_s_sorted, (x, k) -> (k > 0 and _s_sorted[k - 1].h = x.h) or "
        "(k + 1 < size(_s_sorted) and _s_sorted[k + 1].h = x.h)), x -> x.i))"
    )
    covered = F.aggregate(
        found,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return three.select(*keep, *counted, covered.alias("n_repeat_words"))


#: Features for learning: shares that don't depend on a text's length, and two sizes.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbol_share": "coalesce(try_divide(n_symbols, word_chars), 0D)",
    "upper_share": "coalesce(try_divide(n_upper, word_chars), 0D)",
    "point_share": "coalesce(try_divide(n_points, word_chars), 0D)",
    "shout_share": "coalesce(try_divide(n_shouts, n_words), 0D)",
    "digit_share": "coalesce(try_divide(n_digits, word_chars), 0D)",
    "distinct_share": "coalesce(try_divide(n_distinct, n_words), 0D)",
    "stutter_share": "coalesce(try_divide(n_stutter, n_words), 0D)",
    "dup_line_share": "coalesce(try_divide(n_dup_lines, n_lines), 0D)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
    "line_words": "coalesce(try_divide(n_words, n_lines), 0D)",
}


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with statistics and, under the names of ``FEATURES``, prefixed ``f_``, the features."""
    return with_statistics(docs).withColumns({f"f_{k}": F.expr(v) for k, v in FEATURES.items()})


def fold(modulus: int):
    """Remainder of the CRC-32 of a document's id as text; a null id has remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, bound: int) -> DataFrame:
    """``docs(doc_id, text)`` with ``y`` for at most ``bound`` labelled ids, drawn by a hash of the id among those allowed.

    Of rows that share an id the text with the least hash is taken, so ``bound`` bounds the rows and a rerun learns from the same.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    ids = ids.orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(bound)
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return own.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, allowed, rows: int = 2000) -> DataFrame:
    """``(doc_id, y, text)`` of all labelled ids among those allowed, about ``rows`` of them in each partition, by id.

    Of rows that share an id the text with the least hash is taken; null texts are empty.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
    parts = max(1, -(-ids.count() // rows))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).repartition(parts, "doc_id")
    own = docs.where(F.col("doc_id").isNotNull() & allowed).select("doc_id", "text").repartition(parts, "doc_id").join(ids.hint("shuffle_hash"), "doc_id")
    own = own.groupBy("doc_id", "y").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    return own.sortWithinPartitions("doc_id")
