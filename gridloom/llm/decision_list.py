"""Quality rules: a learned decision list, compiled to ordered Spark conditional expressions.

Sequential covering as in RIPPER: rules for the class "bad" are grown one after another on two thirds of what is not yet
covered, adding the threshold condition with the highest information gain, then pruned from their end on the other
third; a rule that is of no worth there or doesn't reach ``least_precision`` on both parts ends the list. Learning runs on the driver over a bounded sample
of statistics (numbers, no texts); the list is applied by built-in functions only.

Cases: null and empty texts have no words and fail the base rules; without labels, or with one class only, the list is
empty and the base rules decide alone; an empty table gives an empty result; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import FEATURES, labelled_sample, with_features

#: Labelled documents that the list is learned from, at most.
SAMPLE = 4000

Condition = tuple[str, str, float]


def _thresholds(x: np.ndarray, most: int = 64) -> np.ndarray:
    v = np.unique(x)
    mid = (v[1:] + v[:-1]) / 2
    return mid if len(mid) <= most else np.unique(np.quantile(x, np.linspace(0, 1, most + 2)[1:-1], method="midpoint"))


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL gain of covering p bad and n good where before p0 and n0 were."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _holds(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, t in rule:
        v = x[:, names.index(name)]
        out &= v > t if op == ">" else v <= t
    return out


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], least_precision: float = 0.9, most_rules: int = 20, most_conditions: int = 4) -> list[list[Condition]]:
    """Ordered rules for ``bad`` over the columns ``names`` of ``x``. The same rows give the same rules."""
    rules: list[list[Condition]] = []
    part = np.arange(len(x)) % 3
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (bad & left).sum() >= 3:
        grow, prune = left & (part != 2), left & (part == 2)
        rule: list[Condition] = []
        cover = grow.copy()
        while len(rule) < most_conditions and (cover & ~bad).any() and (cover & bad).any():
            best: tuple[float, Condition] | None = None
            p0, n0 = float((cover & bad).sum()), float((cover & ~bad).sum())
            for j, name in enumerate(names):
                v, b = x[cover, j], bad[cover]
                for t in [_thresholds(v)]:
                    if not len(t):
                        continue
                    above = v[:, None] > t[None, :]
                    p, n = (above & b[:, None]).sum(0), (above & ~b[:, None]).sum(0)
                    for op, g in ((">", _gain(p, n, p0, n0)), ("<=", _gain(p0 - p, n0 - n, p0, n0))):
                        k = int(np.argmax(g))
                        if best is None or g[k] > best[0] + 1e-12:
                            best = (float(g[k]), (name, op, float(t[k])))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            cover &= _holds(x, names, [best[1]])
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            hit = prune & _holds(x, names, rule[:k])
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            worth.append((p - n) / (p + n) if p + n else -1.0)
        rule = rule[: int(np.argmax(worth)) + 1]
        hit = left & _holds(x, names, rule)
        if not hit.any() or (hit & bad).sum() < least_precision * hit.sum() or max(worth) <= 0:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def compiled(rules: list[list[Condition]], prefix: str = "f_") -> Column:
    """The number of the first rule that holds, from 1, or 0: an ordered conditional expression."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, op, t in rule:
            c = F.col(prefix + name)
            test = test & (c > t if op == ">" else c <= t)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> list[list[Condition]]:
    """Learns from ``labels(doc_id, quality)``, 0 being bad."""
    names = list(FEATURES)
    sample = with_features(labelled_sample(docs, labels, "quality", F.lit(True), bound))
    got = sorted(tuple(r) for r in sample.select("doc_id", "y", *[f"f_{n}" for n in names]).collect())
    if not got:
        return []
    table = np.array([r[1:] for r in got], float)
    return learn(table[:, 1:], table[:, 0] == 0, names)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base statistics of every row of ``docs(doc_id, text)`` with ``base_failed``, ``rule`` and ``kept``.

    base_failed: fewer than ten words, or over a fifth of them in repeated windows. kept: neither that nor any rule.
    """
    rule = compiled(fit(docs, labels))
    got = with_features(docs.select("doc_id", "text")).withColumn("rule", rule)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("rule") == 0)).alias("kept"), "rule",
    )
