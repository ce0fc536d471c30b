"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Each source is one stream of words, its documents in a seeded order. The stream is cut into blocks of the same number
of words; sources too small for enough of them have blocks of a smaller size, a power of two, and are apportioned among those of
that size alone, so a small source changes no other's blocks. Sainte-Laguë gives the next block to the source with the highest quotient wanted / (2 * given + 1); the
sequence of given blocks is cut into shards, which fixes an integer quota per source and shard. A seeded permutation
of a source's blocks then says which blocks its quota takes: every block once before any is taken twice.

Only one row per source reaches the driver (the mixture's own configuration). Positions in a stream come from sums
over ``SLOTS`` hash ranges of each source, so a source that holds a third of all rows is spread over that many windows.

Cases: a null source is a source of its own, last in order; null and empty texts have size 0, and take nothing; rows
that repeat a doc_id are rows of their own; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, is_word_count

#: Hash ranges of one source's stream.
SLOTS = 4096
#: No more sources than this, as the driver holds one row for each.
MAX_SOURCES = 1_000_000
#: Columns that a plan adds; those of the documents that have such a name are replaced.
ADDED = ("size", "source_size", "target", "taken", "m_parts")


@dataclass
class Source:
    key: str
    size: int
    weight: float
    target: float = 0.0
    block: int = 1
    blocks: int = 0
    wanted: float = 0.0
    quota: int = 0


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """``share`` times all sizes by weight; what is above ``cap`` times a size goes to the others by weight."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def apportion(wanted: list[float], most: list[int], seats: int) -> list[int]:
    """Sainte-Laguë: ``seats`` by highest quotients, no source above ``most``; ties go to the earlier source.

    The divisor is found by bisection and the last seats by quotient, so the work doesn't grow with the seats.
    """
    seats = min(seats, sum(most))
    given = lambda d: [min(m, math.floor(w / d + 0.5)) for w, m in zip(wanted, most, strict=True)]
    low, high = 1e-12, max([2 * w for w in wanted], default=1.0) + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(given(mid)) > seats else (low, mid)
    out = given(high)
    while sum(out) < seats:
        i = max((i for i in range(len(out)) if out[i] < most[i]), key=lambda i: (wanted[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 17,
    shards: int = 16,
    smallest_blocks: int = 256,
    most_block: int = 1024,
) -> DataFrame:
    """All rows of ``docs(doc_id, text, source, ...)`` with ``size, source_size, target, taken`` and ``m_parts``.

    ``weights`` repeat over the sources in code-point order. A source's blocks have ``most_block`` words or,
    where it is wanted for fewer than ``smallest_blocks`` of those, the largest power of two that gives so many, one word at least. ``m_parts`` lists (start, end, times, shards):
    word ranges of the document, how often each is taken and by which shards.
    """
    rows = docs.withColumns(
        {
            "m_key": F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")),
            "size": is_word_count(F.col("text")),
            "m_order": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
        }
    )
    rows = rows.withColumn("m_slot", F.expr(f"cast(shiftrightunsigned(m_order, {64 - int(math.log2(SLOTS))}) as int)"))
    slots = rows.groupBy("m_key", "m_slot").agg(F.sum("size").alias("m_sum")).persist()
    sums = slots.groupBy("m_key").agg(F.sum("m_sum").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # Code-point order with null last.
    found = sorted(((r.m_key[0] == "n", r.m_key[1:], r.m_key, r.n) for r in sums), key=lambda x: x[:2])
    sources = [Source(x[2], x[3], float(weights[i % len(weights)])) for i, x in enumerate(found)]
    for s, t in zip(sources, targets([s.size for s in sources], [s.weight for s in sources], share, cap), strict=True):
        s.target = t
    for s in sources:
        most_own = int(s.target) // smallest_blocks
        s.block = most_block if most_own >= most_block else 1 << max(0, most_own.bit_length() - 1)
        s.blocks = max(1, s.size // s.block) if s.size else 0
        s.wanted = s.target * s.blocks / s.size if s.size else 0.0
    ends = [[0] * shards for _ in sources]
    for block in sorted({s.block for s in sources}):
        own = [i for i, s in enumerate(sources) if s.block == block]
        wanted, most = [sources[i].wanted for i in own], [cap * sources[i].blocks for i in own]
        seats = round(sum(wanted))
        for p in range(shards):
            for i, n in zip(own, apportion(wanted, most, round(seats * (p + 1) / shards)), strict=True):
                ends[i][p] = n
    table = []
    for i, s in enumerate(sources):
        s.quota = ends[i][-1]
        step = next((a for a in range(int(s.blocks * 0.618) | 1, s.blocks + 2) if math.gcd(a, max(1, s.blocks)) == 1), 1)
        shift = (seed * 2654435761 + i * 40503) % max(1, s.blocks)
        table.append((s.key, s.size, s.target, s.block, s.blocks, s.quota, step, shift, ends[i]))
    spark = docs.sparkSession
    known = spark.createDataFrame(
        table,
        "m_key string, source_size long, target double, m_block long, m_blocks long, m_quota long, m_step long, m_shift long, m_ends array<long>",
    )
    before = F.sum("m_sum").over(Window.partitionBy("m_key").orderBy("m_slot")) - F.col("m_sum")
    offsets = slots.withColumn("m_before", before).drop("m_sum").join(F.broadcast(known) if len(table) < 10_000 else known, "m_key")
    in_slot = Window.partitionBy("m_key", "m_slot").orderBy("m_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("m_in", F.sum("size").over(in_slot) - F.col("size")).join(offsets, ["m_key", "m_slot"])
    rows = rows.withColumn("m_at", F.col("m_before") + F.col("m_in"))
    # A block's rank in the seeded permutation: it is taken by draw `rank` and, in a second round, by `rank + blocks`.
    parts = F.expr("""
        case when size = 0 then array() else transform(
            sequence(least(m_at div m_block, m_blocks - 1), least((m_at + size - 1) div m_block, m_blocks - 1)),
            b -> named_struct(
                'start', greatest(b * m_block - m_at, 0L),
                'end', case when b = m_blocks - 1 then size else least((b + 1) * m_block - m_at, size) end,
                'rank', (b * m_step + m_shift) % m_blocks)) end""")
    draws = ", ".join(f"rank + {k} * m_blocks" for k in range(cap))
    draws = draws.replace("rank", "p.rank")
    cut = F.expr(f"""
        filter(transform(m_raw, p -> named_struct(
            'start', p.start, 'end', p.end,
            'shards', transform(filter(array({draws}), d -> d < m_quota), d -> size(filter(m_ends, e -> e <= d))))),
            p -> size(p.shards) > 0)""")
    rows = rows.withColumn("m_raw", parts).withColumn("m_parts", cut)
    rows = rows.withColumn("taken", F.expr("aggregate(m_parts, 0L, (a, p) -> a + (p.end - p.start) * size(p.shards))"))
    return rows.select(*[c for c in docs.columns if c not in ADDED], *ADDED)


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each copy of a document is a row with the words it takes.

    A copy that takes a whole document keeps its text as it is; of others the taken words are joined by spaces and
    ``n_chars``, where there is such a column, is counted anew.
    """
    settings = {"cap": 2} | settings
    plan = mix_plan(docs.withColumnsRenamed({c: f"m_own_{c}" for c in ADDED}), **settings)
    plan = plan.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.lit(settings["cap"]))))
    plan = plan.withColumn("m_parts", F.expr("filter(m_parts, p -> size(p.shards) >= m_copy)"))
    plan = plan.withColumn("m_words", F.expr("aggregate(m_parts, 0L, (a, p) -> a + p.end - p.start)"))
    plan = plan.where("m_words > 0 or (size = 0 and m_copy = 1)")
    some = F.expr(
        f"array_join(flatten(transform(m_parts, p -> slice(regexp_extract_all(text, r'{WORD}', 0), "
        "cast(p.start + 1 as int), cast(p.end - p.start as int)))), ' ')"
    )
    whole = F.col("m_words") == F.col("size")
    plan = plan.withColumn("m_text", F.when(whole, F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        plan = plan.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("m_text").cast(docs.schema["n_chars"].dataType)))
    plan = plan.withColumn("text", F.col("m_text"))
    return plan.select(*[F.col(f"m_own_{c}").alias(c) if c in ADDED else F.col(c) for c in docs.columns])
