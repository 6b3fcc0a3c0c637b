"""Quality: Bradley-Terry scores learnt from preference pairs.

A document with label 1 is preferred to one with label 0. The chance that i is
preferred to j is logistic in u(i) - u(j), where the score u is linear in the
documents' features, so the weights are fitted by logistic loss on feature
differences. Features describe a text's form (characters, words, lines,
repetition), not its words, each as a value, its square and a saturated form.

Learning takes every labelled row. Each row of the commoner label is paired with
one of the other, in turn, so that all rows of both stand in pairs; few rows are
paired in several rounds, up to MIN_PAIRS pairs. Features are made where the texts
lie; tasks sum slopes over pairs, and the driver gets these sums alone. Scores are mapped to 0..1 by
a logistic fit on all rows. The operator's decision is a threshold at an exact
quantile of their scores: the share of rows that aren't preferred, as
long as it rejects at most `reject_share` of the preferred ones.

Null and empty texts have features of zero and get a score like any other. With
labels of one kind only, or none, every text gets the share of label 1 and
nothing is rejected. Rows keep their number and all their columns, whatever the
columns' names; ids may be null (never learnt from) or repeat; an empty table
gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.functions.numeric import exact_quantiles
from deltaspan.llm.common import checkpoint, crc_mod, ship, spans, table, with_scores, worker_cache
from deltaspan.llm.toxicity import platt, usable_labels

MIN_PAIRS, RIDGE = 30_000, 1e-3
#: Rows of the rarer label up to which they go to every task, and hash ranges in which rows are numbered.
BROADCAST, RANGES = 10_000, 256
#: Most of the preferred rows that may fall below the threshold.
REJECT_SHARE = 0.01

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b" \t\r\x0b\x0c":
    _CLASS[_c] = 4
_CLASS[ord("\n")] = 5
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 6
_CLASS[ord("!")] = 7
for _c in b"|<>{}[]=/\\_*#@&%$^~+`":
    _CLASS[_c] = 8
_CLASS[128:] = 9
N_RAW = 18
#: Characters beyond which a text is read part by part.
LONG = 1 << 21


def features(text: str) -> list[float]:
    """Of a whole text; an empty one has zeros."""
    if len(text) > LONG:
        return long_features(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_RAW
    # Characters that UTF-8 can't hold count as others beyond ASCII.
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = len(data)
    count = np.bincount(_CLASS[data], minlength=10)
    letters = count[1] + count[2] + count[9] + 1
    lines = [x for x in text.split("\n") if x]
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n), size / n, len(set(words)) / n, same / n, (pairs + 1) / n,
        count[2] / letters, count[3] / size, count[4] / size, count[5] / n, count[6] / n,
        count[7] / n, count[8] / n, count[9] / letters, len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)), float(max(map(len, words)) > 40), (count[7] + count[8]) / size, 1.0 / n,
    ]


def _ids(parts: Iterator[str], split) -> np.ndarray:
    """64-bit hashes of all that `split` finds in the parts, in order."""
    import xxhash

    found = [np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in split(p)), np.uint64) for p in parts]
    return np.concatenate(found or [np.zeros(0, np.uint64)])


def long_features(text: str) -> list[float]:
    """As `features`, from 64-bit hashes of words and lines read part by part, so that a long text's words aren't held."""
    h = _ids(spans(text), str.split)
    n = len(h)
    if not n:
        return [0.0] * N_RAW
    count, size = np.zeros(10, np.int64), 0
    longest = 0
    for part in spans(text):
        data = np.frombuffer(part.encode("utf-8", "replace"), np.uint8)
        size += len(data)
        count += np.bincount(_CLASS[data], minlength=10)
        longest = max(longest, max(map(len, part.split()), default=0))
    lines = _ids(spans(text, "\n"), lambda p: [x for x in p.split("\n") if x])
    letters = count[1] + count[2] + count[9] + 1
    with np.errstate(over="ignore"):
        pairs = len(np.unique(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return [
        np.log1p(n), size / n, len(np.unique(h)) / n, int((h[1:] == h[:-1]).sum()) / n, (pairs + 1) / n,
        count[2] / letters, count[3] / size, count[4] / size, count[5] / n, count[6] / n,
        count[7] / n, count[8] / n, count[9] / letters, len(np.unique(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)), float(longest > 40), (count[7] + count[8]) / size, 1.0 / n,
    ]


def expand(raw: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.clip((raw - mean) / std, -6, 6)
    return np.concatenate([z, z * z / 6, np.tanh(2 * z)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    threshold: float

    def scores(self, raw: np.ndarray) -> np.ndarray:
        u = expand(raw, self.mean, self.std) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * u + self.offset, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """l_id, l_y, f_ (the features' bytes) of every row with a usable label."""
    ship(docs.sparkSession)
    d = docs.where(F.col(id_col).isNotNull() & usable(F.col(id_col))).select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).cast("string").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(features(t or "")).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["d_id", "f_"])

    known = usable_labels(labels, label, usable)
    return checkpoint(d.mapInArrow(made, "d_id long, f_ binary").join(known, F.col("d_id") == F.col("l_id")).select("l_id", "l_y", "f_"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, N_RAW)


def _summed(rows: DataFrame, columns: list[str], work) -> list[np.ndarray]:
    """The sums over all rows of the arrays that `work` gives for a batch; a task sends one row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = work(*batch.slice(at, 4096).columns)
                total = some if total is None else [a + b for a, b in zip(total, some)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[np.asarray(x, float).tobytes() for x in total]], pa.list_(pa.binary()))], ["sums"])

    parts = rows.select(*columns).mapInArrow(task, "sums array<binary>").collect()
    return [np.sum([np.frombuffer(r.sums[i]) for r in parts], axis=0) for i in range(len(parts[0].sums))] if parts else []


def paired(rows: DataFrame, there: dict[int, int]) -> DataFrame:
    """good_, bad_: features of pairs in which all rows of both labels stand."""
    rare = int(there[1] < there[0])
    rounds = max(1, min(there[rare], -(-MIN_PAIRS // there[1 - rare])))
    h = F.xxhash64(F.lit("pairs"), F.col("l_id"))
    keyed = rows.withColumn("h_", h).withColumn("r_", F.pmod(h, F.lit(RANGES)))
    sizes = keyed.groupBy("l_y", "r_").agg(F.count("*").alias("n_"))
    starts = sizes.select("l_y", "r_", (F.sum("n_").over(W.partitionBy("l_y").orderBy("r_")) - F.col("n_")).alias("start_"))
    inside = F.row_number().over(W.partitionBy("l_y", "r_").orderBy("h_", "l_id", "f_")) - 1
    numbered = keyed.withColumn("i_", inside).join(F.broadcast(starts), ["l_y", "r_"]).select("l_y", (F.col("start_") + F.col("i_")).alias("i_"), "f_")
    many = numbered.where(F.col("l_y") == 1 - rare).select(F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("k_"), "i_", F.col("f_").alias("many_"))
    few = numbered.where(F.col("l_y") == rare).select(F.col("i_").alias("place_"), F.col("f_").alias("few_"))
    few = F.broadcast(few) if there[rare] <= BROADCAST else few
    both = many.withColumn("place_", F.pmod(F.col("i_") + F.col("k_"), F.lit(there[rare]))).join(few, "place_")
    return checkpoint(both.select(F.col("few_" if rare else "many_").alias("good_"), F.col("many_" if rare else "few_").alias("bad_")))


def _newton(sums, size: int, ridge: float, steps: int) -> np.ndarray:
    """Weights of the least mean loss; `sums` gives the number of pairs, the gradient's and the Hessian's sums at weights."""
    w = np.zeros(size)
    for _ in range(steps):
        n, gradient, hessian = sums(w)
        move = np.linalg.solve(hessian.reshape(size, size) / n + ridge * np.eye(size), gradient / n + ridge * w)
        w = w - move * min(1.0, 5 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def _slopes(d: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance of the wrong order
    return [np.array([len(d)]), -(d.T @ p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()]


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights that minimize the mean logistic loss of the differences, by Newton steps."""
    d = better - worse
    return _newton(lambda w: _slopes(d, w), d.shape[1], ridge, steps)


def bradley_terry_of(pairs: DataFrame, mean: np.ndarray, std: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """The same from `paired` rows."""
    differ = lambda good, bad: expand(_matrix(good), mean, std) - expand(_matrix(bad), mean, std)
    return _newton(lambda w: _summed(pairs, ["good_", "bad_"], lambda good, bad: _slopes(differ(good, bad), w)), 3 * N_RAW, ridge, steps)


def _logistic(rows: DataFrame, model: Model, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic fit of all rows, by Newton steps with a weak pull to (1, 0)."""
    theta = np.array([1.0, 0.0])
    for _ in range(steps):

        def slopes(y: pa.Array, f: pa.Array, theta: np.ndarray = theta) -> list[np.ndarray]:
            u = expand(_matrix(f), model.mean, model.std) @ model.weights
            x = np.c_[u, np.ones(len(u))]
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            return [x.T @ (p - y.to_numpy()), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]

        gradient, hessian = _summed(rows, ["l_y", "f_"], slopes)
        move = np.linalg.solve(hessian.reshape(2, 2) + 0.1 * np.eye(2), gradient + 0.1 * (theta - [1, 0]))
        theta = theta - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def _threshold(rows: DataFrame, model: Model, there: dict[int, int], reject_share: float) -> float:
    """The lower of two exact quantiles: of all scores at the share of label 0, of those of label 1 at `reject_share`."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch.column(1))), pa.float64())], ["l_y", "s_"])

    scores = rows.select("l_y", "f_").mapInArrow(made, "l_y int, s_ double")
    n = there[0] + there[1]
    at = lambda some, size, ranks: exact_quantiles(some, [], "s_", [r / max(size - 1, 1) for r in ranks], "x_").first().x_
    rank = there[0] / n * (n - 1)
    ends = at(scores, n, [int(np.floor(rank)), int(np.ceil(rank))])
    good = at(scores.where("l_y = 1"), there[1], [int(np.floor(reject_share * (there[1] - 1)))])
    return float(min(sum(ends) / 2, good[0]))


def _without(good: float, n: float) -> Model:
    """Of rows of one label, or of none."""
    share = (good + 0.5) / (n + 1)
    return Model(np.zeros(N_RAW), np.ones(N_RAW), np.zeros(3 * N_RAW), 1.0, float(np.log(share / (1 - share))), 0.0)


def fit(sample: list[tuple[str | None, int, str | None]], reject_share: float = REJECT_SHARE) -> Model:
    """From rows on the driver, all of them, as `fit_rows` does from a table."""
    raw = np.array([features(t or "") for t, _, _ in sample]).reshape(-1, N_RAW)
    y = np.array([v for _, v, _ in sample], float)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return _without(y.sum(), len(y))
    mean, std = raw.mean(0), raw.std(0) + 1e-6
    x = expand(raw, mean, std)
    few, many = sorted((good, bad), key=len)
    rounds = max(1, min(len(few), -(-MIN_PAIRS // len(many))))
    ends = [np.tile(many, rounds), few[(np.tile(np.arange(len(many)), rounds) + np.repeat(np.arange(rounds), len(many))) % len(few)]]
    w = bradley_terry(*(x[e] for e in (ends if many is good else ends[::-1])))
    slope, offset = platt(x @ w, y)
    model = Model(mean, std, w, slope, offset, 0.0)
    score = model.scores(raw)
    model.threshold = float(min(np.quantile(score, len(bad) / len(y), method="midpoint"), np.quantile(score[good], reject_share, method="lower")))
    return model


def fit_rows(rows: DataFrame, reject_share: float = REJECT_SHARE) -> Model:
    """From all of `labelled`."""
    moments = _summed(rows, ["l_y", "f_"], lambda y, f: [np.bincount(y.to_numpy(), minlength=2), _matrix(f).sum(0)])
    there = {0: 0, 1: 0} if not moments else {v: int(moments[0][v]) for v in (0, 1)}
    n = there[0] + there[1]
    if not there[0] or not there[1]:
        return _without(there[1], n)
    mean = moments[1] / n
    std = np.sqrt(_summed(rows, ["f_"], lambda f: [((_matrix(f) - mean) ** 2).sum(0)])[0] / n) + 1e-6
    model = Model(mean, std, bradley_terry_of(paired(rows, there), mean, std), 1.0, 0.0, 0.0)
    model.slope, model.offset = _logistic(rows, model)
    model.threshold = _threshold(rows, model, there, reject_share)
    return model


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row_ (the columns `keep`, or all) and score_ for every whole text (null: empty); nothing is shuffled."""
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def scores(texts: list[str]) -> np.ndarray:
        model = worker_cache(key, lambda: held.value)  # caches of an earlier operator go
        return model.scores(np.array([features(t) for t in texts]).reshape(-1, N_RAW))

    return with_scores(docs, text_col, scores, 1024, keep)


def usable(doc_id):
    """Rows whose labels may be learnt from."""
    return crc_mod(doc_id, 5) != 0


def fit_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit_rows(labelled(docs, table(spark, sf_dir, "labels"), "quality", usable))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(spark, docs, sf_dir)
    return score_documents(docs, model, keep=["doc_id"]).select(
        F.col("row_.doc_id").alias("doc_id"),
        (crc_mod(F.col("row_.doc_id"), 5) == 0).alias("held_out"),
        F.col("score_").alias("score"),
        (F.col("score_") >= 0.3).cast("int").alias("predicted"),
        (F.col("score_") >= model.threshold).alias("kept"),
    )
