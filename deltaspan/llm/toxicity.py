"""Toxicity: a convolutional text classifier trained in numpy.

Words (lower case, without punctuation at their ends) hash into two tables whose
rows stand side by side as the word's vector. Filters of several widths slide
over the words, the largest response of each filter is kept, and a logistic
layer weighs them. Words seen in fewer than `min_docs` training documents map to
a zero row, and so does every bucket that training never saw, so words that are
rare or unknown say nothing.

All parameters start at random, and labels reach them through gradients only.
The gradient of a maximum touches one word for each filter and document, so each
pass leaves out half of the words (`word_dropout`): others then come first.

Training takes a bounded sample of the labelled rows (`max_rows`, those with the
smallest hash of id, evenly from both labels as far as they go); scoring takes
every whole text, long ones window by window. Scores are calibrated on training
rows held out of the gradient, and a threshold is chosen on them for each
language. The language picks the threshold only; it is no input of a score.

Null and empty texts have no words and get the score of none. Without labels of
both kinds every text gets the share of the label there is. Rows keep their
number and all their columns, whatever the columns' names; ids may be null
(never learnt from) or repeat; an empty table gives no rows.
"""

from __future__ import annotations

import string
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaspan.llm.common import chosen, crc_mod, spans, table, with_scores, worker_cache

STRIP = string.punctuation + "«»„“”‘’…–—¡¿"


@dataclass
class Config:
    buckets: int = 1 << 17
    dim: int = 8  # of each of the two tables
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    epochs: int = 10
    passes: int = 45_000  # documents seen in all at least, in up to 30 epochs
    word_dropout: float = 0.5
    spread: float = 0.03  # standard deviation of the words' first vectors
    batch: int = 32
    rate: float = 0.01
    min_docs: int = 3
    max_rows: int = 6000
    calibration: float = 0.25
    seed: int = 7


class Words(dict):
    """Word to its two buckets in one integer; starts anew at `limit` words."""

    def __init__(self, buckets: int, limit: int = 200_000):
        import xxhash

        self.hash, self.mask, self.limit = xxhash.xxh3_64_intdigest, buckets - 1, limit
        self.bits = buckets.bit_length() - 1

    def __missing__(self, word: str) -> int:
        plain = word.lower().strip(STRIP)
        h = self.hash(plain.encode())
        # Bucket 0 is the zero row, for pieces without a letter or digit.
        value = ((h & self.mask) or 1) | (((h >> 40) & self.mask) or 1) << self.bits if plain else 0
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        found = []
        for part in spans(text):
            words = part.split()
            found.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        return found[0] if len(found) == 1 else np.concatenate(found or [np.zeros(0, np.int64)])


def _conv(first: np.ndarray, later: list[np.ndarray]) -> np.ndarray:
    """Responses at each place: later[j] holds what the j-th word behind adds."""
    out = first.copy()
    for j, x in enumerate(later, 1):
        out[:-j] += x[j:]
    return out


class Network:
    """Parameters and both directions of the classifier."""

    def __init__(self, config: Config, rng: np.random.Generator):
        c = self.config = config
        self.e1 = rng.normal(0, c.spread, (c.buckets, c.dim)).astype(np.float32)
        self.e2 = rng.normal(0, c.spread, (c.buckets, c.dim)).astype(np.float32)
        self.w = [rng.normal(0, 0.3, (k, 2 * c.dim, c.filters)).astype(np.float32) for k in c.widths]
        self.b = [np.zeros(c.filters, np.float32) for _ in c.widths]
        self.out = rng.normal(0, 0.3, len(c.widths) * c.filters).astype(np.float32)
        self.bias = np.float32(0)
        self.platt = (1.0, 0.0)

    def start(self, docs: list[np.ndarray]) -> None:
        """Zero the rows of buckets that no word of enough documents falls into."""
        c = self.config
        bits, mask = c.buckets.bit_length() - 1, c.buckets - 1
        keys, n = np.unique(np.concatenate([*(np.unique(d) for d in docs), [0]]), return_counts=True)
        kept = keys[(n >= c.min_docs) & (keys != 0)]
        for e, bucket in ((self.e1, kept & mask), (self.e2, kept >> bits)):
            live = np.zeros(c.buckets, bool)
            live[bucket] = True
            e[~live] = 0

    def split(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, mask = self.config.buckets.bit_length() - 1, self.config.buckets - 1
        return words & mask, words >> bits

    def train(self, docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
        c = self.config
        pad = np.zeros(max(c.widths), np.int64)
        dense = [*self.w, *self.b, self.out]
        m1, m2 = [np.zeros_like(x) for x in dense], [np.zeros_like(x) for x in dense]
        g1, g2 = np.full(self.e1.shape, 1e-6, np.float32), np.full(self.e2.shape, 1e-6, np.float32)
        self.bias = np.float32(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        step = 0
        for _ in range(max(c.epochs, min(30, c.passes // max(len(docs), 1)))):
            for ids in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // c.batch)):
                step += 1
                flat = np.concatenate(list(chain.from_iterable((docs[i], pad) for i in ids)))
                flat = np.where(rng.random(len(flat), np.float32) < c.word_dropout, 0, flat)
                lengths = np.array([len(docs[i]) + len(pad) for i in ids])
                starts = np.cumsum(lengths) - lengths
                h1, h2 = self.split(flat)
                x = np.concatenate([self.e1[h1], self.e2[h2]], axis=1)
                pooled, places = [], []
                for k, w, b in zip(c.widths, self.w, self.b):
                    r = _conv(x @ w[0], [x @ w[j] for j in range(1, k)])
                    top = np.maximum.reduceat(r, starts, axis=0)
                    at = np.where(r == np.repeat(top, lengths, axis=0), np.arange(len(flat))[:, None], len(flat))
                    places.append(np.minimum.reduceat(at, starts, axis=0))
                    pooled.append(np.maximum(top + b, 0))
                z = np.concatenate(pooled, axis=1)
                drop = (rng.random(z.shape) < 0.8) / np.float32(0.8)
                p = 1 / (1 + np.exp(-((z * drop) @ self.out + self.bias)))
                d = ((p - y[ids]) / len(ids)).astype(np.float32)
                grads_out = (z * drop).T @ d + 1e-4 * self.out
                dz = d[:, None] * self.out[None, :] * drop * (z > 0)
                grads_w, grads_b, hit, amount = [], [], [], []
                for n, (k, w, place) in enumerate(zip(c.widths, self.w, places)):
                    dr = dz[:, n * c.filters : (n + 1) * c.filters].astype(np.float32)
                    grads_b.append(dr.sum(0))
                    gw = np.zeros_like(w)
                    for j in range(k):
                        at = np.minimum(place + j, len(flat) - 1)
                        gw[j] = np.einsum("bfd,bf->df", x[at], dr)
                        hit.append(at.ravel())
                        amount.append((dr[:, :, None] * w[j].T[None]).reshape(-1, 2 * c.dim))
                    grads_w.append(gw + 1e-4 * w)
                hit, amount = np.concatenate(hit), np.concatenate(amount)
                for q, (param, grad) in enumerate(zip(dense, [*grads_w, *grads_b, grads_out])):
                    m1[q] = 0.9 * m1[q] + 0.1 * grad
                    m2[q] = 0.99 * m2[q] + 0.01 * grad * grad
                    param -= c.rate * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.99**step)) + 1e-8)
                self.bias -= np.float32(c.rate * d.sum())
                for e, g, h, part in ((self.e1, g1, h1, amount[:, : c.dim]), (self.e2, g2, h2, amount[:, c.dim :])):
                    rows, back = np.unique(h[hit], return_inverse=True)
                    total = np.zeros((len(rows), c.dim), np.float32)
                    np.add.at(total, back, part)
                    live = rows[(e[rows] != 0).any(1)]
                    total = total[(e[rows] != 0).any(1)]
                    g[live] += total * total
                    e[live] -= c.rate * 2 * total / np.sqrt(g[live])

    def compact(self) -> tuple:
        """Rows that say something, for the broadcast: at most as many as the training words."""
        a, b = (np.flatnonzero((e != 0).any(1)) for e in (self.e1, self.e2))
        return self.config, a, self.e1[a], b, self.e2[b], self.w, self.b, self.out, self.bias, self.platt


class Scorer:
    """Scores whole texts with the broadcast parameters."""

    def __init__(self, parts: tuple):
        c, a, ea, b, eb, self.w, self.b, self.out, self.bias, self.platt = parts
        self.config = c
        self.words = Words(c.buckets)
        d = c.dim
        # Row 0 is zero; buckets map to rows.
        self.at1, self.at2 = np.zeros(c.buckets, np.int32), np.zeros(c.buckets, np.int32)
        self.at1[a], self.at2[b] = np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)
        add = lambda e, part: np.concatenate([np.zeros((1, sum(c.widths) * c.filters), np.float32), np.concatenate([e @ w[j, part] for w in self.w for j in range(len(w))], axis=1)])
        self.p1, self.p2 = add(ea, slice(0, d)), add(eb, slice(d, 2 * d))

    def logits(self, docs: list[np.ndarray], window: int = 20_000) -> np.ndarray:
        """Of whole documents: so many at once that the arrays stay small, long ones in windows."""
        c = self.config
        pad = np.zeros(max(c.widths), np.int64)
        out = np.empty(len(docs), np.float32)
        at = 0
        while at < len(docs):
            end, n = at, 0
            while end < len(docs) and (end == at or n + len(docs[end]) <= window):
                n += len(docs[end]) + len(pad)
                end += 1
            if len(docs[at]) > window:
                pooled = self.long(docs[at], pad, window)
                end = at + 1
            else:
                flat = np.concatenate(list(chain.from_iterable((d, pad) for d in docs[at:end])))
                lengths = np.array([len(d) + len(pad) for d in docs[at:end]])
                starts = np.cumsum(lengths) - lengths
                pooled = np.concatenate([np.maximum.reduceat(r, starts, axis=0) for r in self.responses(flat)], axis=1)
            out[at:end] = np.maximum(pooled + np.concatenate(self.b), 0) @ self.out + self.bias
            at = end
        return out

    def responses(self, flat: np.ndarray) -> list[np.ndarray]:
        """What the filters of each width give at each place."""
        c = self.config
        bits, mask = c.buckets.bit_length() - 1, c.buckets - 1
        x = self.p1[self.at1[flat & mask]] + self.p2[self.at2[flat >> bits]]
        out, col = [], 0
        for k in c.widths:
            parts = [x[:, col + j * c.filters : col + (j + 1) * c.filters] for j in range(k)]
            col += k * c.filters
            out.append(_conv(parts[0], parts[1:]))
        return out

    def long(self, doc: np.ndarray, pad: np.ndarray, window: int) -> np.ndarray:
        """Largest responses of one document; each window also sees the words that its last filters reach."""
        doc, best = np.concatenate([doc, pad]), None
        for at in range(0, len(doc), window):
            part = [r[:window].max(0) for r in self.responses(doc[at : at + window + len(pad) - 1])]
            part = np.concatenate(part)[None]
            best = part if best is None else np.maximum(best, part)
        return best

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(docs).astype(np.float64) + b, -30, 30)))


def platt(logit: np.ndarray, y: np.ndarray, steps: int = 50, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic fit of weighted rows, by Newton steps with a weak pull to (1, 0)."""
    theta, x = np.array([1.0, 0.0]), np.c_[logit, np.ones(len(logit))].astype(np.float64)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.1 * (theta - [1, 0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        theta -= np.clip(move, -1, 1)
    return max(float(theta[0]), 1e-3), float(theta[1])


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Of 0.20, 0.25, ... 0.50, the one of the best F1 of weighted rows; 0.30 and what is nearest to it among equals."""
    grid = np.round(np.arange(0.2, 0.51, 0.05), 2)
    w = np.ones(len(y)) if weight is None else weight

    def f1(t: float) -> float:
        hit = score >= t
        return 2 * float(w[hit & (y == 1)].sum()) / max(float(w[hit].sum() + (w * y).sum()), 1.0)

    return float(max(grid, key=lambda t: (round(f1(t), 6), -abs(t - 0.3))))


@dataclass
class Model:
    parts: tuple
    threshold: float
    by_lang: dict[str, float]


def fit(sample: list[tuple[str | None, int, str | None]], config: Config | None = None, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """From (text, label, lang) rows; lang serves the thresholds only."""
    c = config or Config()
    rng = np.random.default_rng(c.seed)
    words = Words(c.buckets)
    docs = [words.of(t or "") for t, _, _ in sample]
    y = np.array([v for _, v, _ in sample], float)
    net = Network(c, rng)
    held = np.zeros(len(docs), bool)
    held[rng.permutation(len(docs))[: int(len(docs) * c.calibration)]] = True
    if len(docs) == 0 or y.min() == y.max():
        net.out[:] = 0
        net.bias = np.float32(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        net.e1[:], net.e2[:] = 0, 0
        return Model(net.compact(), 0.3, {})
    used = [d for d, h in zip(docs, held) if not h]
    net.start(used)
    net.train(used, y[~held], rng)
    logit = Scorer(net.compact()).logits(docs)
    fitted = held if y[held].sum() >= 5 else np.ones(len(docs), bool)
    # The labelled rows that a row of either label stands for: the calibration is to their share, not to the sample's.
    weight = np.array(weights)[y.astype(int)]
    net.platt = platt(logit[fitted], y[fitted], weight=weight[fitted] / weight[fitted].mean())
    scorer = Scorer(net.compact())
    score = scorer.scores(docs)
    langs = np.array([lang or "" for _, _, lang in sample])
    by_lang = {str(g): best_threshold(score[m], y[m], weight[m]) for g in set(langs[fitted]) - {""} if (m := fitted & (langs == g)).sum() >= 50 and y[m].sum() >= 10}
    return Model(net.compact(), best_threshold(score[fitted], y[fitted], weight[fitted]), by_lang)


def usable_labels(labels: DataFrame, label: str, usable) -> DataFrame:
    """l_id, l_y of usable rows; labels other than 0 and 1 are left out."""
    return labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable(F.col("doc_id"))).groupBy(F.col("doc_id").alias("l_id")).agg(F.max(label).alias("l_y"))


def shares(known: DataFrame, max_rows: int) -> dict[int, tuple[int, int]]:
    """For labels 0 and 1: how many rows there are, and how many to take, half of `max_rows` each as far as they go."""
    there = {0: 0, 1: 0} | {int(r.l_y): r["count"] for r in known.groupBy("l_y").count().collect()}
    one = min(there[1], max(max_rows // 2, max_rows - there[0]))
    return {0: (there[0], min(there[0], max_rows - one)), 1: (there[1], one)}


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable, max_rows: int, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", balance: dict[int, tuple[int, int]] | None = None) -> list[tuple]:
    """At most `max_rows` (text, label, lang) rows, those with the smallest hash of id, of each label as many as `balance` says."""
    known = usable_labels(labels, label, usable)
    if balance is None:
        known = chosen(known, "l_id", max_rows, f"train {label}")
    else:
        some = [chosen(known.where(F.col("l_y") == y), "l_id", take, f"train {label}") for y, (_, take) in balance.items()]
        known = some[0].unionByName(some[1])
    d = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = d.join(F.broadcast(known), F.col("d_id") == F.col("l_id")).select("l_id", "text", "l_y", "lang")
    return [(r.text, int(r.l_y), r.lang) for r in sorted(rows.toLocalIterator(), key=lambda r: (r.l_id, r.text or ""))]


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row_ (the columns `keep`, or all) and score_ for every whole text (null: empty); nothing is shuffled."""
    held, key = docs.sparkSession.sparkContext.broadcast(model.parts), uuid.uuid4().hex

    def scores(texts: list[str]) -> np.ndarray:
        scorer = worker_cache(key, lambda: Scorer(held.value))
        return scorer.scores([scorer.words.of(t) for t in texts])

    return with_scores(docs, text_col, scores, 512, keep)


def threshold_of(model: Model, lang) -> F.Column:
    out = F.lit(model.threshold)
    for name, value in sorted(model.by_lang.items()):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def usable(doc_id):
    """Rows whose labels may be learnt from."""
    return crc_mod(doc_id, 4) != 2


def fit_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels")
    taken = shares(usable_labels(labels, "toxic", usable), Config.max_rows)
    sample = training_rows(docs, labels, "toxic", usable, Config.max_rows, balance=taken)
    return fit(sample, weights=tuple(there / max(take, 1) if take else 1.0 for there, take in taken.values()))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(spark, docs, sf_dir)
    scored = score_documents(docs, model, keep=["doc_id", "lang"])
    doc_id, lang = F.col("row_.doc_id"), F.col("row_.lang")
    return scored.select(
        doc_id.alias("doc_id"),
        (crc_mod(doc_id, 4) == 2).alias("held_out"),
        F.col("score_").alias("score"),
        (F.col("score_") >= 0.3).cast("int").alias("predicted"),
        threshold_of(model, lang).alias("lang_threshold"),
        (F.col("score_") >= threshold_of(model, lang)).alias("flagged"),
    )
