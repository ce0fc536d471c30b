"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark column expressions.

As in RuleFit: small trees are grown on random parts of a bounded sample, every path from a root to a node becomes a
conjunctive rule, lasso logistic regression (proximal gradient) picks and weighs few of them, and the weighed rules become
one sum of conditional expressions under a logistic function. The lang, source and id of a document are never read.

Cases: null and empty texts are scored by their statistics, all zero; without labels every score is 0.5, with one class
the share of ones, smoothed; an empty table gives an empty result; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import FEATURES, fold, labelled_sample, with_features

#: Labelled documents that the ensemble is learned from, at most.
SAMPLE = 5000

Rule = tuple[tuple[str, str, float], ...]


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float] | None:
    best = None
    for j in features:
        o = np.argsort(x[:, j], kind="stable")
        v, c = x[o, j], np.cumsum(y[o])
        n, k = len(v), np.arange(1, len(v))
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        left, right = c[:-1] / k, (c[-1] - c[:-1]) / (n - k)
        drop = np.where(ok, k * left**2 + (n - k) * right**2, -np.inf)
        i = int(np.argmax(drop))
        if best is None or drop[i] > best[0]:
            best = (float(drop[i]), int(j), float((v[i] + v[i + 1]) / 2))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int, least: int) -> list[Rule]:
    """Rules of all nodes of one regression tree but its root."""
    out: list[Rule] = []
    todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
    while todo:
        rows, path = todo.pop()
        if path:
            out.append(tuple(sorted(path)))
        if len(path) >= depth or len(rows) < 2 * least or y[rows].std() == 0:
            continue
        tried = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        if (split := _best_split(x[rows], y[rows], tried, least)) is None:
            continue
        _, j, t = split
        low = x[rows, j] <= t
        todo += [(rows[low], (*path, (names[j], "<=", t))), (rows[~low], (*path, (names[j], ">", t)))]
    return out


def holds(x: np.ndarray, names: list[str], rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, t in rule:
        v = x[:, names.index(name)]
        out &= v <= t if op == "<=" else v > t
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient; the intercept isn't penalised."""
    n, m = z.shape
    step = 4.0 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w = v = np.zeros(m)
    b = bv = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v + bv, -30, 30)))
        nw = v - step * (z.T @ (p - y)) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = bv - step * float((p - y).mean())
        g = k / (k + 3)
        v, bv, w, b = nw + g * (nw - w), nb + g * (nb - b), nw, nb
    return w, b


def learn(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 60, depth: int = 3, penalty: float = 2e-3, seed: int = 1) -> tuple[list[tuple[Rule, float]], float]:
    """Weighed rules and intercept. The same rows give the same ensemble."""
    if len(y) < 20 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(share / (1 - share)))
    rng, rules = np.random.default_rng(seed), {}
    for _ in range(trees):
        part = rng.choice(len(y), max(20, min(len(y), 1000, len(y) * 2 // 3)), replace=False)
        for r in tree_rules(x[part], y[part], names, rng, int(rng.integers(1, depth + 1)), max(3, len(part) // 100)):
            rules[r] = None
    found = list(rules)
    z = np.stack([holds(x, names, r) for r in found], 1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)
    first = np.sort(first)
    z, found = z[:, first], [found[i] for i in first]
    scale = np.maximum(z.std(0), 1e-3)
    w, b = lasso((z - z.mean(0)) / scale, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return [(found[i], float(w[i] / scale[i])) for i in kept], float(b - (w / scale * z.mean(0))[kept].sum())


def compiled(rules: list[tuple[Rule, float]], intercept: float, prefix: str = "f_") -> Column:
    """The ensemble's score as one column expression."""
    total = F.lit(intercept)
    for rule, w in rules:
        test = F.lit(True)
        for name, op, t in rule:
            c = F.col(prefix + name)
            test = test & (c <= t if op == "<=" else c > t)
        total = total + F.when(test, w).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, allowed, bound: int = SAMPLE) -> tuple[list[tuple[Rule, float]], float]:
    """Learns ``labels.quality`` from the labelled rows that are ``allowed``."""
    names = list(FEATURES)
    sample = with_features(labelled_sample(docs, labels, "quality", allowed, bound))
    got = sorted(tuple(r) for r in sample.select("doc_id", "y", *[f"f_{n}" for n in names]).collect())
    table = np.array([r[1:] for r in got], float).reshape(-1, 1 + len(names))
    return learn(table[:, 1:], table[:, 0], names)


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``; labels of the held-out fold aren't read."""
    score = compiled(*fit(docs, labels, fold(modulus) != held_out))
    got = with_features(docs.select("doc_id", "text")).select("doc_id", (fold(modulus) == held_out).alias("held_out"), score.alias("score"))
    return got.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
