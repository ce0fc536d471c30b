"""Secret scans over an incremental blob ledger, with DataFrame and SQL functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a table of scanned (blob, rule version)
pairs with their findings. A scan hashes the versions, keeps one text of each blob that the ledger doesn't have under the
present rule version, finds the secrets there and appends the pairs; findings are then joined back to all paths
that hold the blob, whenever it was scanned.

A rule finds leftmost, non-overlapping matches; those whose measured group is too short are dropped after matching.
Spans are whole matches in code points, end exclusive.

Cases: null texts are the empty blob; repeated rows give repeated results; a text without finds has counts 0 and
empty span lists; an empty table gives an empty result; columns of the versions other than the key and text are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int


# The kinds, their patterns and least lengths.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
)
VERSION = "base-1"


def found(text: Column, rule: Rule) -> Column:
    """Array of (start, rank, end, kind) of a rule's matches; texts without a match are tested once and not taken apart."""
    pattern, rank = F.lit(rule.pattern), RULES.index(rule) if rule in RULES else len(RULES)
    pieces = F.split(text, rule.pattern, -1)
    whole, measured = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # The k-th match starts behind k + 1 pieces and k matches.
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("p"), whole.alias("w"), measured.alias("m"))
    kind = F.lit(rule.kind)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    walked = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["p"]) + F.length(x["w"])).alias("at"),
            F.when(
                F.length(x["m"]) >= rule.least,
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(x["p"])).alias("start"),
                            F.lit(rank).alias("rank"),
                            (a["at"] + F.length(x["p"]) + F.length(x["w"])).alias("end"),
                            kind.alias("kind"),
                        )
                    ),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.rlike(text, pattern), walked).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs(blob, text)`` with ``spans``, an array of (start, rank, end, kind) by start, then kind as listed."""
    each = blobs.select("blob", *[found(F.col("text"), r).alias(r.kind) for r in rules])
    return each.select("blob", F.sort_array(F.concat(*[F.col(r.kind) for r in rules])).alias("spans"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Scans what the ledger hasn't seen, appends it, and returns ``(path, blob, spans)`` for all ``versions(path, text)``.

    ``ledger`` is the path of the ledger's Parquet table; where there is none yet, it is begun.
    """
    spark = versions.sparkSession
    paths = versions.select("path", F.coalesce("text", F.lit("")).alias("text"))
    paths = paths.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    new = paths.select("blob", "text")
    try:
        seen = spark.read.parquet(ledger).where(F.col("version") == version).select("blob")
        new = new.join(seen, "blob", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    scanned = scan_blobs(new.dropDuplicates(["blob"]), rules)
    scanned.select(F.lit(version).alias("version"), "blob", "spans").write.mode("append").parquet(ledger)
    known = spark.read.parquet(ledger).where((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    none = F.array().cast(known.schema["spans"].dataType)
    return paths.select("path", "blob").join(known, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Counts and spans of every row of ``docs(doc_id, text)``; without a ledger a new one is begun in the shared folder."""
    all_ = scan(docs.select(F.col("doc_id").alias("path"), "text"), ledger or fresh_dir(docs.sparkSession, "ledger"))
    base = F.filter("spans", lambda s: s["rank"] < len(RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return all_.select(
        F.col("path").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in RULES],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
