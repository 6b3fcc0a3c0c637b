"""Language-model scores from a hidden Markov model over words.

Tokens are words (A-Z in lower case) and one end per document. The model emits
classes: each of the `frequent` commonest words is a class of its own, the end is
one, and every other word falls into one of `shapes` classes by its last bytes,
inside which words keep the share that smoothed counts give them. So the
emission table has a fixed size whatever the vocabulary, while the score of a
rare word still rests on its exact count in the whole corpus.

* Counts of all training words are aggregated over the corpus. A word of more
  than WORD_BYTES stands under its 128-bit digest from there on, so that it is
  counted and found like any other.
* Every text is read into classes once; these, two bytes a word, are written in
  the shared folder and serve all that follows.
* Latent states start from a few Baum-Welch rounds on a bounded sample of the
  training documents; then each round runs over all training documents, and
  expected counts, in fixed point so that sums don't depend on their order, are
  aggregated across partitions as decimals.
* Scores are exact: the scaled forward recursion over each whole document. The
  counts of the `listed` commonest words go to every reader; those of the others
  come from a join, none of whose keys has more than a `listed`-th of all words.

Classes, with the unseen word of each shape, share a total of one, so the score
is the logarithm of a probability.

Null and empty texts consist of the end alone. Rows keep their number: ids may
be null or repeat, each row is scored by itself. Without training documents the
model is uniform over states and smoothed counts. An empty table gives no rows.
Only the named columns are read, so others may have any name. Long texts are
read part by part and scored whole, with states kept at the starts of windows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaspan.llm.common import checkpoint, checkpoint_dir, chosen, crc_mod, ship, spans

END = b""
FIXED = float(1 << 24)
WORD_BYTES = 64


@dataclass
class Config:
    states: int = 8
    frequent: int = 1 << 15
    listed: int = 1 << 17
    shapes: int = 64
    sample_docs: int = 1500
    sample_rounds: int = 12
    corpus_rounds: int = 2
    prior: float = 100.0
    stay: float = 0.9
    seed: int = 5


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a whole text in UTF-8, A-Z lower-cased, cut at ASCII white space, part by part; null has none."""
    for part in spans(text) if text else ():
        yield part.lower().split()


def key_of(word: bytes) -> bytes:
    """The word, or behind a space, which no word holds, the digest of a long one."""
    return word if len(word) <= WORD_BYTES else b" " + hashlib.blake2b(word, digest_size=16).digest()


class Shapes(dict):
    """Class of a word's last three bytes."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, tail: bytes) -> int:
        value = self[tail] = (int.from_bytes(tail, "little") * 0x9E3779B1 >> 7) % self.n
        return value


@dataclass
class Model:
    config: Config
    words: list[bytes]  # those listed, commonest first; the first `frequent` have classes
    counts: np.ndarray  # of those words
    n_tokens: int  # N
    n_types: int  # V
    n_docs: int  # the end's count
    shape_mass: np.ndarray  # sum of (count + 0.5) of a shape's words without classes, and 0.5 for an unseen one
    start: np.ndarray = None
    move: np.ndarray = None
    emit: np.ndarray = None  # classes x states

    @property
    def z(self) -> float:
        return self.n_tokens + 0.5 * (self.n_types + 1)

    @property
    def size(self) -> int:
        """Words with classes."""
        return min(len(self.words), self.config.frequent)

    def base(self) -> np.ndarray:
        """Smoothed shares of the classes; they sum to one."""
        share = np.concatenate([self.counts[: self.size] + 0.5, [self.n_docs + 0.5 * (self.n_docs > 0)], self.shape_mass])
        return share / share.sum()

    def begin(self) -> None:
        c, rng = self.config, np.random.default_rng(self.config.seed)
        base = self.base()
        emit = base[:, None] * np.exp(rng.normal(0, 0.7, (len(base), c.states)))
        self.emit = emit / emit.sum(0)
        self.start = np.full(c.states, 1 / c.states)
        self.move = np.full((c.states, c.states), (1 - c.stay) / max(c.states - 1, 1))
        np.fill_diagonal(self.move, c.stay if c.states > 1 else 1.0)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """The next parameters from expected counts."""
        c = self.config
        self.start = (start + 1) / (start.sum() + c.states)
        self.move = (move + 1 / c.states) / (move.sum(1, keepdims=True) + 1)
        self.emit = (emit + c.prior * self.base()[:, None]) / (emit.sum(0) + c.prior)


class Reader:
    """Words to classes and to what their counts give."""

    def __init__(self, model: Model):
        self.n, self.shapes = model.size, Shapes(model.config.shapes)
        self.at = {w: i for i, w in enumerate(model.words)}
        self.classes = np.arange(len(model.words), dtype=np.int32)
        self.classes[self.n :] = [self.n + 1 + self.shapes[w[-3:]] for w in model.words[self.n :]]
        self.logs = np.log10(model.counts + 0.5)
        self.beyond = np.where(np.arange(len(model.words)) >= self.n, self.logs, 0.0)
        self.mass = np.log10(model.shape_mass)
        self.end = np.log10(model.n_docs + 0.5)

    def read(self, text: bytes | None) -> tuple[np.ndarray, int, float, float, Counter]:
        """Classes of the words and the end; words listed; the sum of the logs of their counts and the end's; what
        words without classes add to the model's score so far; and the words that aren't listed."""
        classes, rare, listed, base, inside = [], Counter(), 0, self.end, 0.0
        for words in words_of(text):
            found = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
            gaps = np.flatnonzero(found < 0)
            keys = []
            for i in gaps.tolist():
                key = key_of(words[i])
                if key is not words[i]:
                    found[i] = self.at.get(key, -1)
                keys.append(key)
            known = found >= 0
            part = self.classes[found] if len(self.classes) else np.zeros(len(found), np.int32)
            for i, key in zip(gaps.tolist(), keys):
                if found[i] < 0:
                    part[i] = self.n + 1 + self.shapes[key[-3:]]
                    rare[key] += 1
            listed += int(known.sum())
            if len(self.logs):
                base += float(self.logs[found[known]].sum())
                inside += float(self.beyond[found[known]].sum())
            shaped = part[part > self.n] - (self.n + 1)
            inside -= float(self.mass[shaped].sum())
            classes.append(part)
        return np.concatenate([*classes, np.array([self.n], np.int32)]), listed, base, inside, rare


def groups(seqs: list[np.ndarray], rows: int = 512, cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of like length side by side, longest first: their places, lengths and (time x row) classes."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    at = 0
    while at < len(order):
        width = len(seqs[order[at]])
        ids = order[at : at + max(1, min(rows, cells // max(width, 1)))]
        at += len(ids)
        lengths = np.array([len(seqs[i]) for i in ids])
        x = np.zeros((width, len(ids)), np.int32)
        for j, i in enumerate(ids):
            x[: lengths[j], j] = seqs[i]
        yield ids, lengths, x


def forward(model: Model, lengths: np.ndarray, x: np.ndarray, keep: bool = False, block: int = 1 << 14):
    """log likelihoods by the scaled recursion; with `keep` also all scaled states and scales."""
    width, n = x.shape
    live = np.searchsorted(-lengths, -np.arange(width), side="left")  # rows longer than t
    block = width if keep else min(width, block)
    scale = np.ones((block, n))
    alphas = np.zeros((width, n, model.config.states)) if keep else None
    alpha, total = np.tile(model.start, (n, 1)), np.zeros(n)
    for t in range(width):
        m, at = live[t], t % block
        if t and not at:
            total += np.log(scale).sum(0)
            scale[:] = 1
        a = (alpha[:m] @ model.move if t else alpha[:m]) * model.emit[x[t, :m]]
        s = a.sum(1)
        a /= s[:, None]
        alpha = a
        scale[at, :m] = s
        if keep:
            alphas[t, :m] = a
    total += np.log(scale).sum(0)
    return (total, alphas, scale, live) if keep else total


def expected(model: Model, seqs: list[np.ndarray], cells: int = 300_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the sequences, and their log likelihood; sequences beyond `cells` go in windows."""
    k = model.config.states
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    for seq in (s for s in seqs if len(s) > cells):
        found = expected_long(model, seq, max(cells // 8, 1))
        start, move, emit, total = start + found[0], move + found[1], emit + found[2], total + found[3]
    seqs = [s for s in seqs if len(s) <= cells]
    for _, lengths, x in groups(seqs, cells=cells) if seqs else ():
        ll, alphas, scale, live = forward(model, lengths, x, keep=True)
        total += float(ll.sum())
        width = len(x)
        gamma = alphas  # turned into posteriors from the end on
        beta = np.ones((x.shape[1], k))
        for t in range(width - 1, 0, -1):
            m = live[t]
            right = model.emit[x[t, :m]] * beta[:m] / scale[t, :m, None]
            move += (alphas[t - 1, :m].T @ right) * model.move
            gamma[t, :m] *= beta[:m]
            beta[:m] = right @ model.move.T
        gamma[0] *= beta
        start += gamma[0].sum(0)
        flat = x.ravel()
        for j in range(k):
            emit[:, j] += np.bincount(flat, gamma[:, :, j].ravel(), minlength=len(emit))
    return start, move, emit, total


def expected_long(model: Model, seq: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """As `expected` of one sequence: states are kept where windows start, and each window's are found again from there."""
    k, emit, move = model.config.states, model.emit, model.move

    def states(before: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alphas, scale = np.empty((len(part), k)), np.empty(len(part))
        for t, c in enumerate(part.tolist()):
            a = before * emit[c]
            scale[t] = a.sum()
            alphas[t] = a = a / scale[t]
            before = a @ move
        return alphas, scale, before

    before, starts, total = model.start, [], 0.0
    for at in range(0, len(seq), window):
        starts.append(before)
        _, scale, before = states(before, seq[at : at + window])
        total += float(np.log(scale).sum())
    moves, emits, beta, right = np.zeros((k, k)), np.zeros(emit.shape), np.ones(k), None
    for n in range(len(starts) - 1, -1, -1):
        part = seq[n * window : (n + 1) * window]
        alphas, scale, _ = states(starts[n], part)
        for t in range(len(part) - 1, -1, -1):
            if right is not None:
                moves += np.outer(alphas[t], right)
                beta = move @ right
            right = emit[part[t]] * beta / scale[t]
            alphas[t] *= beta
        for j in range(k):
            emits[:, j] += np.bincount(part, alphas[:, j], minlength=len(emits))
    return alphas[0], moves * move, emits, total


def training(docs: DataFrame, id_col: str, text_col: str, usable) -> DataFrame:
    return docs.where(usable(F.col(f"`{id_col}`"))).select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def word_counts(rows: DataFrame, limit: int = 300_000) -> DataFrame:
    """word (binary), c: of all rows; the end is the empty word. Workers count ahead, up to `limit` words at a time."""
    ship(rows.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            names, values = [key_of(w) for w in held], list(held.values())
            held.clear()
            for at in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 50_000], pa.binary()), pa.array(values[at : at + 50_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in words_of(text):
                    held.update(words)
                    if len(held) > limit:
                        yield from out()
                held[END] += 1
        yield from out()

    return rows.select("text").mapInArrow(partial, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def commonest(counts: DataFrame, n: int) -> tuple[list[bytes], np.ndarray]:
    """About the n commonest words, commonest first, and their counts.

    Counts fall into logarithmic classes; the highest classes that fit together
    are taken, and of the next one the words of small hashes, so no task sends
    more than it has of these words.
    """
    words = counts.where(F.length("word") > 0).withColumn("level", F.floor(F.log2("c") * 16).cast("int"))
    least, room, share = 1 << 30, n, 0
    for level, size in sorted(((r.level, r["count"]) for r in words.groupBy("level").count().collect()), reverse=True):
        if size > room:
            share = int((1 << 30) * 0.98 * room / size)
            break
        least, room = level, room - size
    below = words.where(F.col("level") < least).agg(F.max("level")).first()[0] if share else None
    part = F.lit(False) if below is None else (F.col("level") == below) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share)
    found = words.where((F.col("level") >= least) | part).select("word", "c").toArrow()
    rows = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist()), key=lambda r: (-r[1], r[0]))
    return [w for w, _ in rows], np.array([c for _, c in rows], float)


def shape_masses(counts: DataFrame, model: Model) -> np.ndarray:
    held = counts.sparkSession.sparkContext.broadcast((set(model.words[: model.size]), model.config.shapes))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = held.value
        shapes, mass = Shapes(n), [0] * n
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word != END and word not in table:
                    mass[shapes[word[-3:]]] += 2 * c + 1
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(mass, pa.int64())], ["shape", "twice"])

    rows = counts.select("word", "c").mapInArrow(partial, "shape int, twice bigint").groupBy("shape").agg(F.sum("twice").alias("twice")).collect()
    out = np.full(model.config.shapes, 0.5)
    for r in rows:
        out[r["shape"]] += r["twice"] / 2
    return out


def count(docs: DataFrame, c: Config, id_col: str, text_col: str, usable) -> tuple[Model, DataFrame]:
    """The model before training and the checkpointed counts of all training words."""
    counts = checkpoint(word_counts(training(docs, id_col, text_col, usable)))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words, size = commonest(counts, c.listed)
    model = Model(c, words, size, n, v, ends, np.zeros(c.shapes))
    model.shape_mass = shape_masses(counts, model)
    model.begin()
    return model, counts


def encode(docs: DataFrame, model: Model, id_col: str, text_col: str, usable) -> DataFrame:
    """uid, doc_id, learnt, n_tokens, n_known, base, inside, seq (classes), rare (word, n): every whole text, written in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    held, kind = spark.sparkContext.broadcast(model), "<u2" if len(model.emit) <= 1 << 16 else "<u4"
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = held.value
        reader, uid = Reader(model), TaskContext.get().partitionId() << 40
        for full in batches:
            for at in range(0, full.num_rows, 512):
                batch = full.slice(at, 512)
                found = [reader.read(t) for t in batch.column(2).to_pylist()]
                n = np.array([len(f[0]) for f in found])
                known = np.array([f[1] for f in found]) + (model.n_docs > 0)
                base = np.array([f[2] for f in found]) - np.log10(model.z) * n
                ends = np.cumsum([0, *(len(f[4]) for f in found)])
                rare = pa.StructArray.from_arrays([pa.array([w for f in found for w in f[4]], pa.binary()), pa.array([m for f in found for m in f[4].values()], pa.int32())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + len(found))), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array([f[3] for f in found], pa.float64()), pa.array([f[0].astype(kind).tobytes() for f in found], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare).cast(rare_type)],
                    ["uid", "doc_id", "learnt", "n_tokens", "n_known", "base", "inside", "seq", "rare"],
                )
                uid += len(found)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), usable(F.col(f"`{id_col}`")).alias("learnt"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    path = f"{checkpoint_dir(spark)}/classes_{uuid.uuid4().hex}"
    rows.mapInArrow(read, "uid bigint, doc_id bigint, learnt boolean, n_tokens bigint, n_known bigint, base double, inside double, seq binary, rare array<struct<word: binary, n: int>>").write.parquet(
        path,
    )
    return spark.read.parquet(path)


def classes_of(seq: bytes, model: Model) -> np.ndarray:
    return np.frombuffer(seq, "<u2" if len(model.emit) <= 1 << 16 else "<u4").astype(np.int32)


def corpus_round(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of one Baum-Welch round, aggregated across partitions; what reaches the driver has the table's size."""
    k, held = model.config.states, rows.sparkSession.sparkContext.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        sums = None
        seqs: list[np.ndarray] = []
        size = 0

        def add(sums):
            found = expected(model, seqs)[:3]
            seqs.clear()
            return found if sums is None else tuple(a + b for a, b in zip(sums, found))

        for batch in batches:
            for seq in batch.column(0).to_pylist():
                seqs.append(classes_of(seq, model))
                size += len(seqs[-1])
                if size > 1_000_000:
                    sums, size = add(sums), 0
        if seqs:
            sums = add(sums)
        if sums is None:
            return
        start, move, emit = sums
        full = np.rint(np.concatenate([emit, start[None], move]) * FIXED).astype(np.int64)
        live = np.flatnonzero(full.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), *(pa.array(full[live, j]) for j in range(k))], ["row", *(f"s{j}" for j in range(k))])

    total = lambda j: F.sum(F.col(f"s{j}").cast("decimal(38,0)")).cast("double").alias(f"s{j}")
    found = rows.select("seq").mapInArrow(partial, "row int, " + ", ".join(f"s{j} bigint" for j in range(k))).groupBy("row").agg(*[total(j) for j in range(k)])
    full = np.zeros((len(model.emit) + 1 + k, k))
    for r in found.toLocalIterator():
        full[r[0]] = r[1:]
    full /= FIXED
    n = len(model.emit)
    return full[n], full[n + 1 :], full[:n]


def train(model: Model, rows: DataFrame) -> Model:
    """Baum-Welch on encoded rows: rounds on a sample, then on all of them."""
    c = model.config
    ids = F.broadcast(chosen(rows.select("uid", "doc_id").where("doc_id is not null"), "doc_id", c.sample_docs, "lm").select(F.col("uid").alias("s_id")))
    sample = [classes_of(bytes(r.seq), model) for r in sorted(rows.select("uid", "doc_id", "seq").join(ids, F.col("uid") == F.col("s_id"), "left_semi").toLocalIterator(), key=lambda r: (r.doc_id, bytes(r.seq)))]
    if sample:
        for _ in range(c.sample_rounds):
            model.update(*expected(model, sample)[:3])
        for _ in range(c.corpus_rounds):
            model.update(*corpus_round(rows, model))
    return model


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of encoded rows."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for full in batches:
            for at in range(0, full.num_rows, 2048):
                batch = full.slice(at, 2048)
                seqs = [classes_of(x, model) for x in batch.column(6).to_pylist()]
                ll = np.zeros(len(seqs))
                for ids, lengths, x in groups(seqs):
                    ll[ids] = forward(model, lengths, x) / np.log(10)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(ll)], ["uid", "doc_id", "n_tokens", "n_known", "base", "inside", "ll"])

    own = rows.select("uid", "doc_id", "n_tokens", "n_known", "base", "inside", "seq").mapInArrow(
        scored,
        "uid bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, inside double, ll double",
    )
    rare = rows.select(F.col("uid").alias("r_uid"), F.inline("rare")).join(counts, "word", "left")
    logs = F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))
    rare = rare.groupBy("r_uid").agg(F.sum(logs).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.join(rare, F.col("uid") == F.col("r_uid"), "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + more("known")).alias("n_known"),
        F.lit(int(model.n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + more("rare")).alias("base_score"),
        (F.col("ll") + F.col("inside") + more("rare")).alias("score"),
    )


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", usable, config: Config | None = None) -> tuple[Model, DataFrame]:
    """The model, learnt from usable rows, and the checkpointed counts of all their words."""
    model, counts = count(docs, config or Config(), id_col, text_col, usable)
    return train(model, encode(docs, model, id_col, text_col, usable).where("learnt")), counts


def score_documents(docs: DataFrame, model: Model, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text (null: empty); rows may repeat."""
    return score(encode(docs, model, id_col, text_col, lambda _: F.lit(True)), model, counts)


def usable(doc_id):
    """Documents that the model learns from."""
    return crc_mod(doc_id, 5) != 1


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, counts = count(docs, Config(), "doc_id", "text", usable)
    rows = encode(docs, model, "doc_id", "text", usable)
    return score(rows, train(model, rows.where("learnt")), counts).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1)
