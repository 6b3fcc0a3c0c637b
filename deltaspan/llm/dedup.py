"""Near-duplicates by HyperMinHash: compressed registers, banding, estimation, verification.

A document's set holds its distinct shingles, hashed to 64 bits. A register
keeps the smallest hash of its bucket as a count of leading zeros and some
mantissa bits. Sets of at least `split` shingles spread over buckets of one hash
(empty buckets stay empty); smaller sets, which would leave most buckets empty,
give each bucket a hash function of its own. Sets up to a quarter above `split`
have both sketches, so any two sets that may be linked share one kind.

1. Equal sets become one class with a number of its own; a group of thousands
   of copies is one row from here on.
2. Bands of registers are keys. Every class meets the leader of each of its
   buckets. Jaccard estimates, corrected for registers that agree by chance,
   sort out most wrong pairs; the rest are verified on full sets: a leader's set
   goes once to each chunk of its members, which are compared as they stream by.
3. Verified links give components. Buckets that still span several components
   are compared once more, members of different components only, so a link that
   no leader saw is found as well: on full sets, in groups of a bounded number of
   shingles. Buckets too large for one group are cut into blocks, and each two
   blocks that may hold a link meet in a group.

Keys that very many rows share (a band, a leader, a set, a component) join by
broadcast: at most HOT keys can have more than a HOT-th of all rows each.

With 40 bands of 5 registers a pair at similarity 0.8 shares no band once in
8 million times.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from deltaspan.llm.common import checkpoint, checkpoint_dir, ship, worker_cache

EMPTY = np.uint16(0xFFFF)
HOT = 20_000
U = np.uint64


@dataclass(frozen=True)
class Config:
    shingle: int = 2
    similarity: int = 80  # percent
    bands: int = 40
    rows: int = 5
    split: int = 400
    mantissa: int = 10
    slack: float = 5.0  # standard deviations that an estimate may lie below the similarity
    chunk: int = 512  # members that meet their leader together
    group: int = 2_000_000  # shingles that one group of an exact comparison holds
    broadcast_rows: int = 2_000_000  # ids (8 bytes each) up to which a semi-join broadcasts

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes(dict):
    """64-bit hashes of words; starts anew at `limit` words."""

    def __init__(self, limit: int = 500_000):
        import xxhash

        self.hash, self.limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        value = self.hash(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def shingles(self, text: str | None, size: int) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles; with fewer words the whole sequence is one."""
        words = text.encode("utf-8", "replace").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = min(size, len(h))
        out = mix(h[: len(h) - n + 1] + U(n))
        for j in range(1, n):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
        return np.unique(out)


def compress(x: np.ndarray, mantissa: int) -> np.ndarray:
    """Leading zeros and the bits behind the first one, of 64-bit fractions."""
    x = np.maximum(x, U(1))
    zeros = (64 - np.frexp(x.astype(np.float64))[1]).clip(0, 62).astype(np.uint64)
    bits = ((x << zeros) << U(1)) >> U(64 - mantissa)
    return ((zeros << U(mantissa)) | bits).astype(np.uint16)


class Sketch:
    def __init__(self, c: Config):
        self.c = c
        rng = np.random.default_rng(97)
        self.salt = rng.integers(0, 1 << 63, (c.registers, 1), dtype=np.uint64)
        self.odd = rng.integers(0, 1 << 63, (c.registers, 1), dtype=np.uint64) * U(2) + U(1)

    def small(self, h: np.ndarray) -> np.ndarray:
        """A hash function for each bucket."""
        low = np.full(self.c.registers, U(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(h), 128):
            x = (h[None, at : at + 128] ^ self.salt) * self.odd
            x ^= x >> U(32)
            x *= U(0x9E3779B97F4A7C15)
            low = np.minimum(low, x.min(1))
        return compress(low, self.c.mantissa)

    def large(self, h: np.ndarray) -> np.ndarray:
        """One hash; buckets by its high bits. Sorted hashes put each bucket's smallest first."""
        m = U(self.c.registers)
        bucket = ((h >> U(32)) * m) >> U(32)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        out = np.full(self.c.registers, EMPTY)
        out[bucket[first].astype(np.int64)] = compress(h[first] * m, self.c.mantissa)
        return out

    def of(self, h: np.ndarray) -> bytes:
        """A kind byte (1 small, 2 large, 3 both) and the registers."""
        kind = (len(h) < self.c.split * 1.25) + 2 * (len(h) >= self.c.split)
        return bytes([kind]) + (self.small(h).tobytes() if kind & 1 else b"") + (self.large(h).tobytes() if kind & 2 else b"")


def registers(sketch: bytes, c: Config) -> dict[int, np.ndarray]:
    data, kinds = np.frombuffer(sketch, np.uint16, offset=1), [k for k in (1, 2) if sketch[0] & k]
    return {k: data[i * c.registers : (i + 1) * c.registers] for i, k in enumerate(kinds)}


def band_keys(sketch: bytes, c: Config) -> np.ndarray:
    """64-bit keys of all bands; a band of empty registers has none."""
    out = []
    for kind, reg in registers(sketch, c).items():
        bands = reg.reshape(c.bands, c.rows).astype(np.uint64)
        key = np.full(c.bands, U(kind)) * U(1 << 20) + np.arange(c.bands, dtype=np.uint64)
        for j in range(c.rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + bands[:, j] + U(1))
        out.append(key[(reg.reshape(c.bands, c.rows) != EMPTY).any(1)])
    return np.concatenate(out).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, c: Config) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for agreement by chance.

    Two independent registers agree when leading zeros and mantissa do: with
    probability sum over z of 4**-(z+1) / 2**mantissa, a third of 2**-mantissa.
    """
    both = (a == EMPTY) & (b == EMPTY)
    used = np.maximum((~both).sum(-1), 1)
    agree = ((a == b) & ~both).sum(-1) / used
    chance = 1 / 3 / (1 << c.mantissa)
    return (agree - chance) / (1 - chance)


def lowest(c: Config) -> float:
    s = c.similarity / 100
    return s - c.slack * (s * (1 - s) / (0.9 * c.registers)) ** 0.5


def fingerprint(h: np.ndarray) -> bytes | None:
    """128 bits of a set, None for an empty one."""
    return mix(h).sum(dtype=np.uint64).tobytes() + mix(h ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes() if len(h) else None


def _hashes() -> Hashes:
    return worker_cache("shingles", Hashes)


def sketches(docs: DataFrame, c: Config, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, print (128 bits of the set; null for an empty one or a null id), sketch."""
    ship(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = _hashes(), Sketch(c)
        for full in batches:
            for at in range(0, full.num_rows, 512):
                part = full.slice(at, 512)
                n, marks, found = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h = hashes.shingles(text, c.shingle)
                    n.append(len(h))
                    linked = len(h) > 0 and key is not None
                    marks.append(fingerprint(h) if linked else None)
                    found.append(sketch.of(h) if linked else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(found, pa.binary())], ["doc_id", "n", "print", "sketch"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id bigint, n bigint, print binary, sketch binary")


def prints(docs: DataFrame, c: Config, id_col: str, text_col: str) -> DataFrame:
    """doc_id, print, held (all hashes of the set) of rows with a set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for full in batches:
            for at in range(0, full.num_rows, 512):
                part = full.slice(at, 512)
                sets = [hashes.shingles(t, c.shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], ["doc_id", "print", "held"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id bigint, print binary, held binary").where(F.col("print").isNotNull())


def marked(rows: DataFrame, c: Config) -> DataFrame:
    """The rows (with a column `text`) and `print`, null without a set."""
    ship(rows.sparkSession)
    schema = StructType([*rows.schema.fields, StructField("print", BinaryType())])
    place, names = rows.columns.index("text"), [*rows.columns, "print"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for full in batches:
            found = [fingerprint(hashes.shingles(t, c.shingle)) for t in full.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*full.columns, pa.array(found, pa.binary())], names)

    return rows.mapInArrow(made, schema)


def full_sets(need: DataFrame, classes: DataFrame, docs: DataFrame, c: Config, id_col: str, text_col: str) -> DataFrame:
    """rep, held: the sets of the classes `need` (rep), written in the shared folder.

    Texts are read again, of those ids only; where an id repeats, the row with
    the class's set stands for it.
    """
    spark = docs.sparkSession
    need = checkpoint(need.distinct().join(classes.select("rep", "low", "print"), "rep"))
    lows = need.select(F.col("low").alias("n_id")).distinct()
    if need.count() <= c.broadcast_rows:
        lows = F.broadcast(lows)
    some = docs.select(F.col(f"`{id_col}`").cast("long").alias("t_id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(lows, F.col("t_id") == F.col("n_id"), "left_semi")
    # Equal rows are dropped by what the join goes by, so the sets are dealt out once.
    found = prints(some, c, "t_id", "text").withColumnRenamed("print", "p_").dropDuplicates(["doc_id", "p_"])
    found = found.join(need, (F.col("doc_id") == F.col("low")) & (F.col("p_") == F.col("print"))).select("rep", "held")
    path = f"{checkpoint_dir(spark)}/sets_{uuid.uuid4().hex}"
    found.write.parquet(path)
    return spark.read.parquet(path)


def frequent(n: int) -> int:
    """Rows that a key has at least to count as hot, if there are n rows: so at most HOT keys are."""
    return max(1000, -(-n // HOT))


def with_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The inner join on `key`, where `hot` (key) names at most HOT keys, whose rows of `right`, one each, are broadcast."""
    hot = F.broadcast(hot)
    return left.join(F.broadcast(right.join(hot, key, "left_semi")), key).unionByName(left.join(hot, key, "left_anti").join(right, key))


def banded(classes: DataFrame, c: Config) -> DataFrame:
    """key, rep: a row for each band of each class."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for at in range(0, full.num_rows, 1024):
                part = full.slice(at, 1024)
                found = [band_keys(s, c) for s in part.column(1).to_pylist()]
                reps = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(reps)], ["key", "rep"])

    return classes.select("rep", "sketch").mapInArrow(keys, "key bigint, rep bigint")


def hot_leaders(pairs: DataFrame) -> DataFrame:
    """lead, members: leaders of so many pairs that they count as hot; checkpointed."""
    return checkpoint(pairs.groupBy("lead").agg(F.count("*").alias("members")).where(F.col("members") > frequent(pairs.count())))


def similar(pairs: DataFrame, classes: DataFrame, c: Config) -> DataFrame:
    """Pairs (lead, rep) whose estimate is not clearly below the similarity. `pairs` is checkpointed."""
    # Names change behind the joins only, so that both read one exchange of the sketches.
    one = classes.select("rep", "n", "sketch")
    two = pairs.join(one, "rep").select("lead", F.col("rep").alias("rep_b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = with_hot(two.withColumnRenamed("lead", "rep"), one, "rep", hot_leaders(pairs).select(F.col("lead").alias("rep")))
    joined = both.select(F.col("rep").alias("lead"), F.col("rep_b").alias("rep"), F.col("n").alias("na"), F.col("sketch").alias("sa"), "nb", "sb")
    joined = joined.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * c.similarity)
    least = lowest(c)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for at in range(0, full.num_rows, 1024):
                part = full.slice(at, 1024)
                good = []
                for sa, sb in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = registers(sa, c), registers(sb, c)
                    kind = max(set(x) & set(y), default=None)
                    good.append(kind is not None and float(estimate(x[kind], y[kind], c)) >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good))], ["lead", "rep"])

    return joined.select("lead", "rep", "sa", "sb").mapInArrow(kept, "lead bigint, rep bigint")


def verified(pairs: DataFrame, sets: DataFrame, c: Config) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity. `pairs` (lead, rep) is checkpointed.

    Members of a leader fall into chunks; the leader's set goes to each chunk
    once and comes first there, so a task holds two sets at a time.
    """
    count = pairs.groupBy("lead").agg(F.ceil(F.count("*") / F.lit(c.chunk)).cast("int").alias("chunks"))
    hot = hot_leaders(pairs).select("lead")
    dealt = with_hot(pairs, count, "lead", hot).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    heads = count.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # Leaders and members meet the sets in one join.
    wanted = dealt.select("lead", "chunk", "rep", F.col("rep").alias("whose")).unionByName(heads.select("lead", "chunk", F.lit(None).cast("long").alias("rep"), F.col("lead").alias("whose")))
    met = wanted.join(sets.withColumnRenamed("rep", "whose"), "whose")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for full in batches:
            for at in range(0, full.num_rows, 256):
                part = full.slice(at, 256)
                found: list[tuple[int, int]] = []
                for lead, rep, held in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    y = np.frombuffer(held, np.uint64)
                    if rep is None:
                        x = y
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= c.similarity * (len(x) + len(y) - both):
                        found.append((lead, rep))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    stream = met.select("lead", "chunk", "rep", "held").repartition(F.col("lead"), F.col("chunk")).sortWithinPartitions("lead", "chunk", F.asc_nulls_first("rep"))
    return stream.select("lead", "rep", "held").mapInArrow(checked, "a bigint, b bigint")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges that one task is given."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(up.setdefault(u, u)), root(up.setdefault(v, v))))
            up[high] = low
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, one_task: int = 400_000) -> DataFrame:
    """node, component (its smallest node) of undirected edges (a, b).

    Up to `one_task` edges (16 bytes each) go to one task. More of them take
    rounds of large and small stars: each keeps the graph's components and turns
    it towards stars, and they end when a round changes nothing. Rounds are
    checkpointed.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.count() <= one_task:
        return checkpoint(now.coalesce(1).mapInArrow(_forest, "node bigint, component bigint"))
    seen = None
    while True:
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = checkpoint(small)
        # A round without change has the same edges: their number and the sums that identify them.
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        if state[0] == 0 or (state == seen and state[0] == state[2]):
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def mixed_buckets(shared: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    """key, rep, comp of buckets that span several components; in a bucket of two its leader has seen the other.

    `shared` (key, rep, size) holds the buckets of several classes.
    """
    members = shared.where("size > 2").join(parts, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = checkpoint(members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x <> y").select("key", "size"))
    return checkpoint(with_hot(members, mixed.select("key"), "key", mixed.where(F.col("size") > limit).select("key")))


def linked(sets: list[np.ndarray], comp: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Places of verified pairs that join what `comp` keeps apart: enough of them for the components of all links.

    Members outside the largest component meet all others. Overlaps are exact:
    for each such member the owners of its shingles are counted.
    """
    values, counts = np.unique(comp, return_counts=True)
    few = np.flatnonzero(comp != values[counts.argmax()])
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
    start = np.r_[0, np.cumsum(np.bincount(ids))]
    of = np.r_[0, np.cumsum(size)]
    name = {x: x for x in comp.tolist()}

    def root(x):
        while name[x] != x:
            name[x] = name[name[x]]
            x = name[x]
        return x

    out = []
    for i in few.tolist():
        own = ids[of[i] : of[i + 1]]
        first, count = start[own], start[own + 1] - start[own]
        shared = count > 1
        first, count = first[shared], count[shared]
        if not len(count):
            continue
        # The postings of all its shingles in one index array.
        at = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
        overlap = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * overlap >= similarity * (size[i] + size - overlap)).tolist():
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                name[x] = y
                out.append((i, j))
    return out


def blocked(rows: DataFrame, c: Config) -> DataFrame:
    """key, rep, comp: buckets dealt out so that any two members of different components meet under some key.

    `rows` has key, rep, comp and n, the shingles. One of the two lies outside
    the bucket's largest component. Members outside it fill blocks of about half
    of `group` shingles and so do those inside; each outer block meets each inner
    and each other outer one, under a key of about `group` shingles. A member's
    copies grow with the number of blocks it meets.
    """
    held = F.greatest(F.lit(1), F.lit(c.group // 2))
    sizes = rows.groupBy("key", "comp").agg(F.sum("n").alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"))
    cut = most.select("key", F.col("most.comp").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / held).alias("outer_"), F.ceil(F.col("most.n") / held).alias("inner_"))
    at = rows.join(cut, "key").withColumn("inside", F.col("comp") == F.col("main"))
    at = at.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "rep"), F.when(F.col("inside"), F.col("inner_")).otherwise(F.col("outer_"))))
    # An outer block is whole under each of its keys with an inner one, of which there is at least one.
    outer = F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer_") - 1))
    inner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("inner_") - 1))
    with_outer, with_inner = at.where("outer_ > 0").withColumn("other", outer), at.where("not inside").withColumn("other", inner)
    key = lambda kind, x, y: F.xxhash64(F.lit(kind), "key", x, y).alias("key")
    cross = with_outer.where("inside").select(key("inner", F.col("other"), F.col("block")), "rep", "comp").unionByName(with_inner.select(key("inner", F.col("block"), F.col("other")), "rep", "comp"))
    among = with_outer.where("not inside and other <> block").select(key("outer", F.least("block", "other"), F.greatest("block", "other")), "rep", "comp")
    return cross.unionByName(among)


def exact(rows: DataFrame, classes: DataFrame, docs: DataFrame, c: Config, id_col: str, text_col: str) -> DataFrame:
    """Verified links (a, b) between different components inside buckets, from full sets."""
    sets = full_sets(rows.select("rep"), classes, docs, c, id_col, text_col)
    rows = rows.join(classes.select("rep", "n"), "rep")

    # Overlapping buckets form a family, whose members then travel once and not with each bucket.
    lead = rows.groupBy("key").agg(F.min("rep").alias("lead"), F.sum("n").alias("weight"))
    families = components(rows.join(lead, "key").select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    families = families.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    families = families.join(families.groupBy("component").agg(F.sum("n").alias("all_")), "component").select(F.col("node").alias("rep"), F.col("component").alias("family"), "all_")
    named = rows.join(families, "rep")
    whole = named.where(F.col("all_") <= c.group).select(F.xxhash64(F.lit("family"), "family").alias("key"), "rep", "comp").distinct()
    named = named.where(F.col("all_") > c.group).join(lead.select("key", "weight"), "key")
    usual = named.where(F.col("weight") <= c.group).select("key", "rep", "comp")
    large = named.where(F.col("weight") > c.group).select("key", "rep", "comp", "n")
    both = whole.unionByName(usual).unionByName(blocked(large, c))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, comp = pdf["rep"].to_numpy(), pdf["comp"].to_numpy()
        if len(set(comp.tolist())) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        found = linked([np.frombuffer(x, np.uint64) for x in pdf["held"]], comp, c.similarity)
        return pd.DataFrame([(min(rep[i], rep[j]), max(rep[i], rep[j])) for i, j in found], columns=["a", "b"], dtype=np.int64)

    return both.join(sets, "rep").groupBy("key").applyInPandas(compared, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, config: Config | None = None, *, id_col: str = "doc_id", text_col: str = "text", with_print: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`; with_print adds 128 bits of its set.

    Every row is a document. Null or empty texts have no shingles, are linked
    with nothing and stay alone; ties don't arise, since a component's smallest
    id names it. Rows with a null id have no component (null) and aren't kept.
    Rows that share an id but not a text may lie in different components, and
    each is linked on its own text; rows with equal ids and equal sets share one.
    An empty table gives no rows. Only the two named columns are read, so others
    may have any name. Very long texts are read whole.
    """
    c = config or Config()
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/sketches_{uuid.uuid4().hex}"
    sketches(docs, c, id_col, text_col).write.parquet(f"{path}/rows")
    drawn = spark.read.parquet(f"{path}/rows")
    equal = drawn.where(F.col("print").isNotNull()).groupBy("print").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows"))
    classes = checkpoint(equal.withColumn("rep", F.monotonically_increasing_id()))
    banded(classes, c).write.parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    limit = frequent(keys.count())
    buckets = checkpoint(keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep"))["rep"].alias("leader"), F.count("*").alias("size")).where("size > 1"))
    # A leader has the smallest hash of its bucket, so a pair comes in one direction only.
    # Keys are dealt out for this once: later steps need those of shared buckets only.
    with_hot(keys, buckets, "key", buckets.where(F.col("size") > limit).select("key")).write.parquet(f"{path}/shared")
    shared = spark.read.parquet(f"{path}/shared")
    pairs = checkpoint(shared.where("rep <> leader").select(F.col("leader").alias("lead"), "rep").distinct())
    tried = checkpoint(similar(pairs, classes, c))
    need = tried.select(F.explode(F.array("lead", "rep")).alias("rep"))
    edges = checkpoint(verified(tried, full_sets(need, classes, docs, c, id_col, text_col), c))
    parts = components(edges)
    rows = mixed_buckets(shared, parts, limit)
    if not rows.isEmpty():
        found = checkpoint(exact(rows, classes, docs, c, id_col, text_col))
        if not found.isEmpty():
            parts = components(edges.unionByName(found))
    # A component takes the smallest id of its classes, and a class's rows take the component's.
    parts = parts.join(classes.select(F.col("rep").alias("node"), "low"), "node")
    names = checkpoint(parts.groupBy("component").agg(F.min("low").alias("name"), F.count("*").alias("members")))
    parts = with_hot(parts.select("node", "component"), names.select("component", "name"), "component", names.where(F.col("members") > frequent(classes.count())).select("component"))
    named = checkpoint(classes.select("print", "rep", "low", "rows").join(parts, F.col("rep") == F.col("node"), "left").select("print", "rows", F.coalesce("name", "low").alias("component_id")))
    linked_ = with_hot(
        drawn.where(F.col("print").isNotNull()).select("doc_id", "n", "print"),
        named.select("print", "component_id"), "print",
        named.where(F.col("rows") > frequent(drawn.count())).select("print"),
    )
    alone = drawn.where(F.col("print").isNull()).select("doc_id", "n", "print", F.col("doc_id").alias("component_id"))
    out = linked_.select("doc_id", "n", "print", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), *["print"] * with_print)


def op10_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
