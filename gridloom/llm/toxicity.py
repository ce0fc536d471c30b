"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy by Spark tasks.

Words are lower-cased, stripped of marks and hashed to 2**24 buckets, and so are their beginnings of four to seven
letters, which inflected words share; a word's vector is the sum over its buckets. Buckets that at least three labelled
documents touch (more where that leaves too many) have an embedding, all others are zero. Filters of width 1, 2 and 3 slide over
the whole text, each keeps its maximum, and a logistic layer weighs the maxima. Training is minibatch Adam over all labelled
documents: each task learns from its own, and the models are averaged after each round. On every fourth document, which isn't
trained on, a threshold is picked for each language, told from the text's own function words; a score
is the logistic function of how far the text is above its language's threshold, so 0.5 is the calibrated border.

Cases: null and empty texts are scored as a text without known words; without labels of both classes every score is the
smoothed share of toxic labels, 0.1 or so; very long texts are scored whole, in pieces; repeated rows give repeated
results; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .stats import fold, labelled_rows

BUCKETS = 1 << 24
#: Embeddings of a model at most, their size, filters of each width.
VOCABULARY, SIZE, FILTERS = 1 << 17, 12, 12
#: Texts of a minibatch, averages of the tasks' models, code points that a task learns from at once.
BATCH, ROUNDS, CHUNK = 16, 2, 8_000_000
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
PIECE = 100_000
#: Words that a task remembers.
MEMORY_WORDS = 500_000

# Function words by which a language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as at be this by from",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als",
    "fr": "le la les et des du une est pour que dans qui par sur pas avec au elle",
    "es": "el la los y que del las un por con una su para es al lo como más",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>|#*$%&-_")


def bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 71) & (BUCKETS - 1)


def buckets_of(word: str) -> list[int]:
    """Buckets of a bare word and, under a mark of their own, of its beginnings."""
    return [bucket(word)] + [bucket(f"{word[:n]}~") for n in PREFIXES if len(word) >= n] if word else []


@dataclass
class Model:
    buckets: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    name: str = ""


class Coder(dict):
    """Memory of word -> place of its vector * 8 + language, 7 for none; place 0 is the zero vector."""

    def __init__(self, model: Model):
        super().__init__()
        self.rows = {int(b): i + 1 for i, b in enumerate(model.buckets)}
        self.model = model
        self.lang: dict[str, int] = {}
        for i, words in enumerate(FUNCTION_WORDS.values()):
            for w in words.split():
                self.lang[w] = 7 if w in self.lang else i  # words of two languages tell nothing
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.places: dict[tuple[int, ...], int] = {(): 0}
        self.begins: dict[str, int] = {}
        self.vectors = np.zeros((1024, self.model.table.shape[1]), np.float32)

    def __missing__(self, word: str) -> int:
        w = bare(word)
        own = tuple(self.known(w))
        if (place := self.places.get(own)) is None:
            place = self.places[own] = len(self.places)
            if place == len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
            self.vectors[place] = self.model.table[list(own)].sum(0)
        code = place * 8 + self.lang.get(w, 7)
        if len(word) < 64:
            self[word] = code
        return code

    def known(self, w: str) -> list[int]:
        """Rows of a word's known buckets. As a longer beginning is in no more documents, the first unknown one ends the search."""
        out = []
        for n in PREFIXES:
            if len(w) < n:
                break
            if (r := self.begins.get(w[:n])) is None:
                r = self.begins[w[:n]] = self.rows.get(bucket(f"{w[:n]}~"), 0)
            if not r:
                return out
            out.append(r)
        if w and (r := self.rows.get(bucket(w))):
            out.append(r)
        return out

    def codes(self, text: str | None) -> np.ndarray:
        """Codes of all words; their places hold until the next call."""
        words = (text or "").lower().split()
        if len(self) > MEMORY_WORDS:
            self.reset()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


#: The memory of the model that this Python process last scored with.
_CODERS: dict[str, Coder] = {}


def coder_of(model: Model) -> Coder:
    if model.name not in _CODERS:
        _CODERS.clear()
        _CODERS[model.name] = Coder(model)
    return _CODERS[model.name]


def language(codes: np.ndarray) -> str:
    n = np.bincount(codes & 7, minlength=8)[: len(FUNCTION_WORDS)]
    return LANGUAGES[int(n.argmax())] if n.any() else "other"


def _convolved(x: np.ndarray, f: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x ends in two rows of padding, which windows at the end run into."""
    n = len(x) - 2
    out = x[:n] @ f[0]
    for k in range(1, len(f)):
        out += x[k : n + k] @ f[k]
    return out + shift


def maxima(model: Model, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Largest answer of every filter over one whole text, before the cut at zero. ``at``: places in ``vectors``, 0 being zero."""
    best = np.concatenate(model.shifts)
    for i in range(0, len(at), PIECE):
        n = min(PIECE, len(at) - i)
        own = at[i : i + n + 2]
        x = vectors[np.concatenate((own, np.zeros(n + 2 - len(own), own.dtype)))]
        best = np.maximum(best, np.concatenate([_convolved(x, f, s).max(0) for f, s in zip(model.filters, model.shifts, strict=True)]))
    return best


def logit(model: Model, vectors: np.ndarray, at: np.ndarray) -> float:
    return float(np.maximum(maxima(model, vectors, at), 0) @ model.weights + model.bias)


def coded(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text as numbers of its words, and the buckets of each numbered word, -1 for none."""
    known: dict[str, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in t.lower().split()], np.int32) for t in texts]
    of = np.full((len(known), 1 + len(PREFIXES)), -1, np.int64)
    for w, i in known.items():
        b = buckets_of(bare(w))
        of[i, : len(b)] = b
    return docs, of


def bucket_counts(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, and in how many texts of either class each is."""
    docs, of = coded(texts)
    inside = [np.unique(of[d]) for d in docs]
    seen, at = np.unique(np.concatenate([*inside, np.empty(0, np.int64)]), return_inverse=True)
    toxic = np.repeat(np.asarray(y) > 0, [len(i) for i in inside])
    n = [np.bincount(at[toxic == c], minlength=len(seen)) for c in (False, True)]
    return seen[seen >= 0], n[0][seen >= 0], n[1][seen >= 0]


def constant_model(y0: int, y1: int) -> Model:
    return Model(np.empty(0, np.int64), np.zeros((1, 1), np.float32), [], [], np.empty(0, np.float32), 0.0, constant=(y1 + 0.2) / (y0 + y1 + 2))


def begin(buckets: np.ndarray, hits: tuple[np.ndarray, np.ndarray], n: tuple[int, int], size: int = SIZE, filters: int = FILTERS, seed: int = 3) -> Model:
    """The untrained model of sorted buckets, each with ``hits`` among the ``n`` documents of either class."""
    rng = np.random.default_rng(seed)
    share = (n[1] + 0.2) / (n[0] + n[1] + 2)
    table = rng.normal(0, 0.1, (len(buckets) + 1, size)).astype(np.float32)
    # One coordinate begins at how much more often toxic documents hold the bucket.
    table[1:, 0] = np.clip(np.log((hits[1] + 0.5) / (max(1, n[1]) + 1)) - np.log((hits[0] + 0.5) / (max(1, n[0]) + 1)), -4, 4) / 4
    table[0] = 0
    model = Model(
        buckets, table, [rng.normal(0, 0.3, (w, size, filters)).astype(np.float32) / w**0.5 for w in WIDTHS],
        [np.zeros(filters, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, filters * len(WIDTHS)).astype(np.float32), float(np.log(share / (1 - share))),
    )
    for f, k in zip(model.filters, range(len(WIDTHS)), strict=True):
        f[:, 0, : filters // 2] = np.abs(f[:, 0, : filters // 2]) + 0.3
        model.weights[k * filters : k * filters + filters // 2] = np.abs(model.weights[k * filters : k * filters + filters // 2])
    return model


class Learner:
    """Adam over minibatches of texts; ``model`` is changed in place."""

    def __init__(self, model: Model, share: float, rate: float = 0.01, seed: int = 3):
        self.model, self.rate, self.rng, self.step = model, rate, np.random.default_rng(seed), 0
        self.heavier = float(min(5.0, max(1.0, (1 - share) / share / 2)))
        self.bias = np.array([model.bias], np.float32)
        self.whole = [*model.filters, *model.shifts, model.weights, self.bias]
        self.m1, self.m2 = [np.zeros_like(p) for p in self.whole], [np.zeros_like(p) for p in self.whole]
        self.t1, self.t2 = np.zeros_like(model.table), np.zeros_like(model.table)

    def learn(self, texts: list[str], y: np.ndarray, epochs: int) -> None:
        """Passes over some texts. The same texts in the same order give the same model."""
        model, bias, table = self.model, self.bias, self.model.table
        buckets, (size, filters) = model.buckets, model.filters[0].shape[1:]
        y, wide = np.asarray(y, np.float32), 1 + len(PREFIXES)
        docs, of = coded(texts)
        at = np.minimum(np.searchsorted(buckets, of), max(0, len(buckets) - 1))
        rows = np.where(buckets[at] == of, at + 1, 0).astype(np.int32) if len(buckets) else np.zeros(of.shape, np.int32)
        rows = np.concatenate((rows, np.zeros((1, wide), np.int32)))  # the last is the padding
        pad = np.full(2, len(rows) - 1, np.int32)
        del of, at
        for _ in range(epochs):
            order = self.rng.permutation(len(docs))
            for i in range(0, len(order), BATCH):
                batch, self.step = order[i : i + BATCH], self.step + 1
                grads = [np.zeros_like(p) for p in self.whole]
                touched: list[np.ndarray] = []
                pushed: list[np.ndarray] = []
                # All texts of the batch in a row, two words of padding behind each.
                own = [np.concatenate((docs[j] if len(docs[j]) else pad[:1], pad)) for j in batch]
                ends = np.cumsum([len(d) for d in own])
                r = rows[np.concatenate(own)]
                x = table[r[:, 0]]
                for k in range(1, wide):
                    x += table[r[:, k]]
                tops, at = [], []
                for f, s in zip(model.filters, model.shifts, strict=True):
                    c = _convolved(x, f, s)
                    a = np.stack([c[e - len(d) : e - 2].argmax(0) + e - len(d) for d, e in zip(own, ends, strict=True)])
                    at.append(a)
                    tops.append(np.take_along_axis(c, a, 0))
                top = np.concatenate(tops, 1)
                act = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ model.weights + bias[0], -30, 30)))
                g = ((p - y[batch]) * np.where(y[batch] > 0, self.heavier, 1.0) / len(batch)).astype(np.float32)
                grads[-1] += g.sum()
                grads[-2] += g @ act
                back = g[:, None] * model.weights * (top > 0)
                for k, f in enumerate(model.filters):
                    b = back[:, k * filters : (k + 1) * filters]
                    grads[len(WIDTHS) + k] += b.sum(0)
                    for o in range(WIDTHS[k]):
                        v = at[k] + o
                        grads[k][o] += np.einsum("dfs,df->sf", x[v], b)
                        touched.append(r[v].reshape(-1))
                        pushed.append(np.repeat((b[:, :, None] * f[o].T[None]).reshape(-1, size), wide, 0))
                t, q = np.concatenate(touched), np.concatenate(pushed)
                u, inv = np.unique(t, return_inverse=True)
                gt = np.zeros((len(u), size), np.float32)
                np.add.at(gt, inv, q)
                gt[u == 0] = 0
                lr = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
                for p_, g_, a, b in zip(self.whole, grads, self.m1, self.m2, strict=True):
                    g_ += 1e-4 * p_
                    a += 0.1 * (g_ - a)
                    b += 0.001 * (g_ * g_ - b)
                    p_ -= (lr * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
                t1, t2 = self.t1, self.t2
                t1[u] += 0.1 * (gt - t1[u])
                t2[u] += 0.001 * (gt * gt - t2[u])
                table[u] -= (lr * t1[u] / (np.sqrt(t2[u]) + 1e-8)).astype(np.float32)
        model.bias = float(bias[0])


def train(texts: list[str], y: np.ndarray, epochs: int = 8) -> Model:
    """A model of some texts in one process, uncalibrated; ``fit`` learns from tables by the same steps."""
    y0, y1 = int((np.asarray(y) == 0).sum()), int((np.asarray(y) > 0).sum())
    if y0 + y1 < 8 or not y0 or not y1:
        return constant_model(y0, y1)
    seen, n0, n1 = bucket_counts(texts, y)
    keep = n0 + n1 >= _least(len(texts))
    model = begin(seen[keep], (n0[keep], n1[keep]), (y0, y1))
    Learner(model, (y1 + 0.2) / (y0 + y1 + 2)).learn(texts, y, epochs)
    model.thresholds = dict.fromkeys(LANGUAGES, 0.0)
    return model


def _least(n: int) -> int:
    """Documents out of ``n`` that a bucket has to be in."""
    return min(3, max(1, n // 20))


def calibrated(scores: np.ndarray, toxic: np.ndarray, n: np.ndarray, tongues: np.ndarray, least: int = 5) -> dict[str, float]:
    """For each language the score between two with the best F1; with fewer than ``least`` toxic documents, that of all.

    Each score stands for ``n`` calibration documents, ``toxic`` of which are.
    """

    def best(s: np.ndarray, t: np.ndarray, m: np.ndarray) -> float:
        o = np.argsort(-s, kind="stable")
        s, t, m = s[o], t[o], m[o]
        f1 = 2 * np.cumsum(t) / (np.cumsum(m) + t.sum())
        f1[np.append(s[1:] == s[:-1], False)] = -1
        k = int(f1.argmax())
        return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1)

    if not toxic.sum() or toxic.sum() == n.sum():
        return dict.fromkeys(LANGUAGES, 0.0)
    all_, out = best(scores, toxic, n), {}
    for g in LANGUAGES:
        m = tongues == g
        enough = min(toxic[m].sum(), n[m].sum() - toxic[m].sum()) >= least
        out[g] = best(scores[m], toxic[m], n[m]) if enough else all_
    return out


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and labels of a task, about ``CHUNK`` code points at once."""
    texts, y, n = [], [], 0
    for pdf in batches:
        for t, v in zip(pdf.text, pdf.y, strict=True):
            texts.append(t), y.append(v)
            n += len(t)
            if n >= CHUNK:
                yield texts, np.array(y, np.float32)
                texts, y, n = [], [], 0
    if texts:
        yield texts, np.array(y, np.float32)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for texts, y in _chunks(batches):
        seen, n0, n1 = bucket_counts(texts, y)
        yield pd.DataFrame({"bucket": seen, "n0": n0, "n1": n1})


def vocabulary(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted buckets and their documents of either class, counted over all ``rows(text, y)``: all in enough documents.

    A model has ``VOCABULARY`` embeddings at most; where more buckets are in enough documents, enough is raised.
    """
    counts = rows.select("text", "y").mapInPandas(_counted, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = written(counts.withColumn("n", F.col("n0") + F.col("n1")).where(F.col("n") >= _least(n)), "counts")
    # Sizes in steps of a sixteenth: a few hundred rows whatever the counts are.
    sized = counts.groupBy(F.floor(F.log2("n") * 16).alias("k")).agg(F.count("*").alias("c"), F.min("n").alias("n")).collect()
    sized.sort(key=lambda r: -r.k)
    inside = [r.n for r, c in zip(sized, np.cumsum([r.c for r in sized]), strict=True) if c <= VOCABULARY]
    got = counts.where(F.col("n") >= (min(inside) if inside else sized[0].n)).select("bucket", "n0", "n1").toArrow() if sized else None
    if got is None:
        return np.empty(0, np.int64), np.empty(0), np.empty(0)
    b, n0, n1 = (got[c].to_numpy() for c in ("bucket", "n0", "n1"))
    o = np.argsort(b)
    return b[o], n0[o], n1[o]


def _flat(model: Model) -> np.ndarray:
    """The filters, shifts, weights and bias in a row of ``SIZE`` columns."""
    x = np.concatenate([p.ravel() for p in (*model.filters, *model.shifts, model.weights)] + [[model.bias]]).astype(np.float64)
    return np.concatenate((x, np.zeros(-len(x) % SIZE))).reshape(-1, SIZE)


#: Steps of which changes are whole multiples, so that sums don't depend on their order.
UNIT = 2.0**-24
_CHANGES = ", ".join(["at long", "w long", *(f"d{i} long" for i in range(SIZE))])


def learned_once(rows: DataFrame, model: Model, share: float, epochs: int, seed: int) -> Model:
    """The model after ``epochs`` passes over all ``rows(text, y)``: each task learns from its own, and what they changed is averaged.

    A task's changes weigh by its rows; those of an embedding are averaged over the tasks that changed it.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = shared.value
        own = replace(before, table=before.table.copy(), filters=[f.copy() for f in before.filters], shifts=[s.copy() for s in before.shifts], weights=before.weights.copy())
        learner, n = Learner(own, share, seed=seed), 0
        for texts, y in _chunks(batches):
            learner.learn(texts, y, epochs)
            n += len(texts)
        if n:
            at = np.flatnonzero((own.table != before.table).any(1))
            dense = _flat(own) - _flat(before)
            d = np.concatenate((own.table[at].astype(np.float64) - before.table[at], dense))
            at = np.concatenate((at, -1 - np.arange(len(dense))))
            out = np.rint(d * n / UNIT).astype(np.int64)
            yield pd.DataFrame({"at": at, "w": n} | {f"d{i}": out[:, i] for i in range(SIZE)})

    sums = [F.sum(c).alias(c) for c in ("w", *(f"d{i}" for i in range(SIZE)))]
    got = rows.select("text", "y").mapInPandas(run, _CHANGES).groupBy("at").agg(*sums).toArrow()
    shared.destroy()
    at, w = got["at"].to_numpy(), got["w"].to_numpy()
    d = np.stack([got[f"d{i}"].to_numpy() for i in range(SIZE)], 1) * UNIT / w[:, None]
    table, dense = model.table.copy(), _flat(model)
    table[at[at >= 0]] += d[at >= 0].astype(np.float32)
    dense[-1 - at[at < 0]] += d[at < 0]
    parts, k = [], 0
    for p in (*model.filters, *model.shifts, model.weights):
        parts.append(dense.ravel()[k : k + p.size].astype(np.float32).reshape(p.shape))
        k += p.size
    w = len(WIDTHS)
    return replace(model, table=table, filters=parts[:w], shifts=parts[w : 2 * w], weights=parts[-1], bias=float(dense.ravel()[k]))


def thresholds_of(rows: DataFrame, model: Model) -> dict[str, float]:
    """The thresholds by language from all ``rows(text, y)``, whose scores are counted in steps of a thousandth."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, name=uuid.uuid4().hex))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        coder = coder_of(model)
        for pdf in batches:
            z, g = [], []
            for t in pdf.text:
                codes = coder.codes(t)
                z.append(logit(model, coder.vectors, codes >> 3))
                g.append(language(codes))
            yield pd.DataFrame({"z": np.rint(np.array(z, float) * 1000).astype(np.int64), "language": g, "y": pdf.y.to_numpy()})

    scored = rows.select("text", "y").mapInPandas(run, "z long, language string, y double")
    got = scored.groupBy("language", "z").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).toArrow()
    return calibrated(got["z"].to_numpy() / 1000, got["toxic"].to_numpy(), got["n"].to_numpy().astype(float), np.array(got["language"].to_pylist()))


def fit(docs: DataFrame, labels: DataFrame, allowed) -> Model:
    """Learns ``labels.toxic`` from all labelled rows that are ``allowed``; three in four are learned from, the others set the thresholds."""
    rows = written(labelled_rows(docs, labels, "toxic", allowed).withColumn("held", F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(4)) == 3), "labelled")
    n = {(r.held, int(r.y > 0)): r.n for r in rows.groupBy("held", "y").agg(F.count("*").alias("n")).collect()}
    y0, y1 = n.get((False, 0), 0), n.get((False, 1), 0)
    if y0 + y1 < 6 or not y0 or not y1:
        return constant_model(y0 + n.get((True, 0), 0), y1 + n.get((True, 1), 0))
    own, share = rows.where("not held"), (y1 + 0.2) / (y0 + y1 + 2)
    buckets, n0, n1 = vocabulary(own, y0 + y1)
    model = begin(buckets, (n0, n1), (y0, y1))
    # Few rows are passed over eight times, many twice.
    epochs = min(4, max(1, 12_000 // (y0 + y1)))
    for k in range(ROUNDS):
        model = learned_once(own, model, share, epochs, 3 + k)
    model.thresholds = thresholds_of(rows.where("held"), model)
    return model


def score_of(model: Model, coder: Coder, text: str | None) -> tuple[float, str]:
    codes = coder.codes(text)
    g = language(codes)
    if model.constant is not None:
        return model.constant, g
    z = logit(model, coder.vectors, codes >> 3) - model.thresholds[g]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), g


def scorer(shared):
    """A column function from texts to (score, language) with the broadcast model."""

    @F.pandas_udf("score double, language string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        coder = coder_of(model)
        for texts in batches:
            yield pd.DataFrame([score_of(model, coder, t) for t in texts], columns=["score", "language"])

    return score


def learned(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int):
    """The scorer learned from all folds but the held-out one."""
    model = fit(docs, labels, fold(modulus) != held_out)
    model.name = uuid.uuid4().hex
    return scorer(docs.sparkSession.sparkContext.broadcast(model))


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """``(doc_id, held_out, score, predicted, language)`` of every row; labels of the held-out fold aren't read."""
    got = docs.select("doc_id", learned(docs, labels, modulus, held_out)("text").alias("s"))
    fold_ = (fold(modulus) == held_out).alias("held_out")
    return got.select("doc_id", fold_, F.col("s.score"), F.when(F.col("s.score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("s.language"))


def without_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """The rows of ``docs`` whose texts score below 0.5, all columns as they were; scored in passing, without a shuffle."""
    score = learned(docs, labels, modulus, held_out)
    return docs.withColumn("t_score", score("text")).where(F.col("t_score.score") < 0.5).drop("t_score")
