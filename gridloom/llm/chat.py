"""Chat formatting of reply trees.

Messages point to the message they answer. Every leaf is one branch; its path to the root is enumerated by self-joins that
double their reach: with jumps of 1, 2, 4, ... messages a branch of depth d takes log2(d) rounds, and no round makes
more rows than the paths have. Branches of a tree are ranked by the mean score of their messages, ties by leaf, and each
chosen path becomes one conversation.

The template is ``<|im_start|>role``, line feed, text, ``<|im_end|>``, line feed for each turn. Control strings inside texts are
escaped reversibly: a ``<`` followed by any number of backslashes and ``|`` gets one more backslash. In roles ``~`` and line
feeds are escaped too, as ``~0`` and ``~1``. The loss mask lists the spans of the assistant's texts in the formatted text.

Cases: null texts and roles are empty; null scores count 0; a parent that isn't there makes its message a root; messages of a
cycle that no root leads to are left out; message ids that repeat within a tree are not allowed (``from_turns`` makes
them unique, rows that repeat a turn included); a null tree id is a tree of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def role_escaped(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def from_turns(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` as messages, each one the answer to the row before it by turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "id", parent.alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """``(tree, leaf, id, up)``: for every leaf of ``messages(tree, id, parent)`` the messages of its path, up from the leaf."""
    nodes = written(messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("null")).alias("tree"), "id", "parent"), "nodes")
    known = nodes.select("tree", F.col("id").alias("parent"))
    jumps = written(nodes.join(known, ["tree", "parent"]).select("tree", "id", F.col("parent").alias("to")), "jumps")
    leaves = nodes.select("tree", "id").join(jumps.select("tree", F.col("to").alias("id")), ["tree", "id"], "left_anti")
    reached = written(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")), "paths")
    roots = written(nodes.select("tree", "id").join(jumps.select("tree", "id"), ["tree", "id"], "left_anti"), "roots")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    parts, far = [reached], 1
    while far < most:
        step = reached.join(jumps, ["tree", "id"]).select("tree", "leaf", F.col("to").alias("id"), (F.col("up") + far).alias("up"))
        step = written(step, "paths")
        if step.isEmpty():
            break
        parts.append(step)
        reached = reached.union(step)
        on = jumps.select("tree", F.col("id").alias("to"), F.col("to").alias("far"))
        jumps = written(jumps.join(on, ["tree", "to"]).select("tree", "id", F.col("far").alias("to")), "jumps")
        far *= 2
    # Only branches that end in a root; one that runs into a cycle never does.
    whole = reached.join(roots, ["tree", "id"], "left_semi").select("tree", "leaf").distinct()
    return reached.join(whole, ["tree", "leaf"], "left_semi")


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """``(tree, leaf, rank, score, turns)`` of the ``top`` branches of every tree of ``messages(tree, id, parent, role, text, score)``."""
    key = F.coalesce(F.col("tree").cast("string"), F.lit("null"))
    said = messages.select(key.alias("tree"), "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    found = written(paths(messages), "paths")
    # Ranks come before texts, so that only chosen paths carry them.
    scored = found.join(said.select("tree", "id", "score"), ["tree", "id"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= top)
    chosen = found.join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi").join(said.drop("score"), ["tree", "id"])
    turns = chosen.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    return turns.join(ranked, ["tree", "leaf"])


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss``, the spans (start, end) of assistants' texts in it, to ``conversations(turns, ...)``."""
    head = lambda t: F.concat(F.lit(START), role_escaped(t["role"]), F.lit("\n"))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("own")))
    got = conversations.withColumn("c_pieces", pieces)
    whole = F.array_join(F.transform("c_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    none = F.array().cast("array<struct<start:int,end:int>>")
    after = lambda a, p: a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END) + 1
    span = lambda a, p: F.struct((a["at"] + F.length(p["head"])).alias("start"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))
    loss = F.aggregate(
        "c_pieces",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda a, p: F.struct(after(a, p).alias("at"), F.when(p["own"], F.concat(a["spans"], F.array(span(a, p)))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return got.withColumn("formatted", whole).withColumn("loss", loss).drop("c_pieces")


def read_back(conversations: DataFrame) -> DataFrame:
    """``turns`` (role, text) and ``loss_text`` again from ``formatted`` and ``loss`` alone; other columns stay."""
    blocks = F.split("formatted", r"<\|im_start\|>")
    body = lambda b: F.substring(b, F.instr(b, "\n") + 1, F.length(b) - F.instr(b, "\n") - len(END) - 1)
    turn = lambda b: F.struct(role_unescaped(F.substring_index(b, "\n", 1)).alias("role"), unescaped(body(b)).alias("text"))
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    got = conversations.withColumn("c_blocks", blocks).withColumn("c_blocks", F.slice("c_blocks", F.lit(2), F.size("c_blocks")))
    return got.withColumn("turns", F.transform("c_blocks", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("c_blocks")
