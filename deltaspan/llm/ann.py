"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

Largest inner products become smallest distances: each vector is scaled by the
largest length and gets one more coordinate that makes it of length one; queries
are scaled to length one and get a zero. Both are rotated at random, so any block
of columns is a fair sample of a distance.

Centroids are fitted on a bounded sample; every vector goes to its nearest list,
and the index stores its rotated columns beside the vector. How many lists a
query probes is decided for it: with a list's spread about its centroid as that
of a normal distribution, the inner products that the list may hold say how many
of the query's neighbours to expect there, and the lists of the most are probed
until they cover SHARE of all. Clustered vectors need few lists, vectors without
structure many.

A query's first threshold is its (k + 1)-th best distance in the sample, and
its first list, which it scans first, may lower it. In all lists columns are
read block by block, and after each block a hypothesis test abandons a
candidate: its distance on d of D columns, scaled by D/d, lies above the
threshold by more than 1 + epsilon/sqrt(d). Blocks are products of matrices
while many candidates are left and run over the remaining pairs then. What
survives all blocks is scored in double precision on the original vectors.

Lists are cut into chunks of bounded size and stand in groups of neighbouring
lists; a query travels once to each piece of a group that it probes, with the
lists as bits. So a list with a third of all vectors is many tasks; equal vectors
are one candidate (see vectors).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.llm.common import checkpoint, chosen, ship
from deltaspan.llm.vectors import NONE, classes, commonest_length, distinct_queries, merged, other_ids, query_rows, results, valid

K, ROUNDS, COLUMNS, EPSILON, SEED = 20, 8, 16, 2.1, 13
#: Vectors that the centroids are fitted on: so many for each list, within the two limits.
PER_CENTROID, SAMPLE, MOST_SAMPLE = 16, 8192, 131_072
#: Rows of a list that one row of the index holds, and queries that meet them at once.
CHUNK, QUERY_CHUNK = 4096, 1024
#: Vectors per list that the number of lists aims at, their largest number, and lists of a group.
PER_LIST, MOST_LISTS, GROUP = 400, 8192, 32
#: Share of the expected neighbours that the probed lists of a query cover.
SHARE = 0.97
#: Chunks of a group that a piece of it has at most, on average.
PIECE = 64
#: More than the k + 1 that could be needed, since distances in single precision order what each chunk gives.
SPARE = 8


def tail(x: np.ndarray) -> np.ndarray:
    """About the chance that a standard normal number lies above x (Lin's exponential form)."""
    y = np.abs(x)
    p = 0.5 * np.exp(-0.717 * y - 0.416 * y * y)
    return np.where(x >= 0, p, 1 - p)


class Space:
    """The rotated space of augmented vectors, the lists' centroids, sizes and spreads."""

    def __init__(self, dim: int, most: float, rng: np.random.Generator):
        self.dim, self.most = dim, most
        self.turn = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0]

    def candidates(self, v: np.ndarray) -> np.ndarray:
        x = v / self.most
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
        return (np.c_[x, rest] @ self.turn).astype(np.float32)

    def queries(self, v: np.ndarray) -> np.ndarray:
        x = v / np.abs(v).max(1, keepdims=True)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        return (np.c_[x, np.zeros(len(x))] @ self.turn).astype(np.float32)

    def fit(self, sample: np.ndarray, lists: int, n: int, rng: np.random.Generator, rounds: int = ROUNDS) -> None:
        """From a sample of n vectors."""
        x = self.sample = self.candidates(sample)
        self.n, self.centroids = n, x[rng.permutation(len(x))[:lists]].copy()
        for _ in range(rounds):
            at = self.nearest(x)
            sums, size = self._sums(x, at)
            self.centroids[size > 0] = (sums / np.maximum(size, 1)[:, None])[size > 0]
        # Neighbouring lists get neighbouring numbers.
        main = np.linalg.svd(self.centroids - self.centroids.mean(0), full_matrices=False)[2][0]
        self.centroids = self.centroids[np.argsort(self.centroids @ main, kind="stable")]
        at = self.nearest(x)
        size = np.bincount(at, minlength=len(self.centroids))
        off = ((x - self.centroids[at]) ** 2).mean(1)
        spread = np.bincount(at, off, minlength=len(size)) / np.maximum(size, 1)
        # Lists of few sample vectors lean on the mean of all.
        self.spread = np.sqrt((spread * size + off.mean() * 4) / (size + 4) + 1e-12)
        self.size = (size + 0.5) * (n / (len(x) + 0.5 * len(size)))

    def _sums(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(at, kind="stable")
        size = np.bincount(at, minlength=len(self.centroids))
        first = np.minimum(np.cumsum(size) - size, len(x) - 1)
        return np.add.reduceat(x[order], first, axis=0), size

    def limits(self, q: np.ndarray, k: int) -> np.ndarray:
        """The k-th best squared distance of each query in the sample, 8 (more than any) if the sample is smaller."""
        if len(self.sample) < k:
            return np.full(len(q), 8.0)
        length, out = (self.sample**2).sum(1), []
        for at in range(0, len(q), 128):
            far = 1 + length[None, :] - 2 * q[at : at + 128] @ self.sample.T
            out.append(np.partition(far, k - 1, axis=1)[:, k - 1].astype(np.float64))
        return np.concatenate(out)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The nearest list of each vector."""
        length = (self.centroids**2).sum(1)
        return np.concatenate([(length[None, :] - 2 * x[at : at + 1024] @ self.centroids.T).argmin(1) for at in range(0, len(x), 1024)])

    def probes(self, q: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query the lists to probe, as booleans, and the first of them."""
        near = (q @ self.centroids.T).astype(np.float64)
        low, high = np.full(len(q), -1.5), np.full(len(q), 1.5)
        expected = lambda t: self.size * tail((t[:, None] - near) / self.spread)
        for _ in range(18):  # the inner product that k vectors are expected to reach
            middle = (low + high) / 2
            many = expected(middle).sum(1) > min(k, self.n)
            low, high = np.where(many, middle, low), np.where(many, high, middle)
        hits = expected(low)
        order = np.argsort(-hits, axis=1, kind="stable")
        covered = np.cumsum(np.take_along_axis(hits, order, 1), axis=1)
        needed = (covered < share * covered[:, -1:]).sum(1) + 1
        out = np.zeros(hits.shape, bool)
        np.put_along_axis(out, order, np.arange(hits.shape[1])[None, :] < needed[:, None], axis=1)
        return out, order[:, 0]


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and candidate places, and squared distances, of candidates that no test abandons; `limit` has squared thresholds."""
    dim = x.shape[1]
    i, j, left, d = None, None, None, 0
    far = np.zeros((len(q), len(x)), np.float32)
    alive = None
    while True:
        b = slice(d, min(d + columns, dim))
        d = b.stop
        bound = limit * np.float32(d / dim * (1 + epsilon / np.sqrt(d)) ** 2) if d < dim else limit * np.float32(1 + 1e-5) + np.float32(1e-6)
        if i is None:
            far += (q[:, b] ** 2).sum(1)[:, None]
            far += (x[:, b] ** 2).sum(1)[None, :]
            far -= 2 * (q[:, b] @ x[:, b].T)
            passed = far <= bound[:, None]
            alive = passed if alive is None else alive & passed
            if d >= dim or np.count_nonzero(alive) * 20 < alive.size:
                i, j = np.nonzero(alive)
                left = far[i, j]
        else:
            left = left + ((q[i, b] - x[j, b]) ** 2).sum(1)
            keep = left <= bound[i]
            i, j, left = i[keep], j[keep], left[keep]
        if d >= dim:
            return i, j, left


class Layout:
    """Lists in groups of at most GROUP, and groups in pieces."""

    def __init__(self, lists: int, n: int, tasks: int):
        self.per = max(1, min(GROUP, lists // max(tasks, 1)))
        self.groups = -(-lists // self.per)
        self.pieces = max(1, -(-n // (self.groups * CHUNK * PIECE)))


def _indexed(members: DataFrame, space, layout: Layout) -> DataFrame:
    """group, piece, slot, cls, low, next_, v, turned: a row for at most some CHUNK rows of a list."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for full in batches:
            for at in range(0, full.num_rows, 2048):
                batch = full.slice(at, 2048)
                x = s.candidates(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                turned = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(4)] + [turned, pa.array(s.nearest(x).astype(np.int32))], ["cls", "low", "next_", "v", "turned", "list"])

    rows = members.select("cls", "low", "next_", "v").mapInArrow(assigned, "cls bigint, low bigint, next_ bigint, v array<double>, turned array<float>, list int")
    rows = checkpoint(rows)
    count = rows.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(CHUNK))).cast("int").alias("chunks"))
    cut = rows.join(count, "list").withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("chunks")).cast("int"))
    each = cut.groupBy("list", "chunk").agg(F.collect_list(F.struct("cls", "low", "next_", "v", "turned")).alias("rows"))
    group, piece = F.floor(F.col("list") / layout.per).cast("int"), F.pmod(F.xxhash64("list", "chunk"), F.lit(layout.pieces)).cast("int")
    return each.select(
        group.alias("group"), piece.alias("piece"), (F.col("list") % layout.per).alias("slot"),
        *[F.col("rows")[c].alias(c) for c in ("cls", "low", "next_")],
        F.flatten(F.col("rows")["v"]).alias("v"), F.flatten(F.col("rows")["turned"]).alias("turned"),
    )


def _probed(queries: DataFrame, space, layout: Layout, k: int, share: float) -> DataFrame:
    """qcls, own, v, limit, group, first, lists, others: a row for each group, with its lists to probe first, then and not, as bits."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        bits = np.int64(1) << np.arange(layout.per, dtype=np.int64)
        for full in batches:
            for at in range(0, full.num_rows, 512):
                batch = full.slice(at, 512)
                own = batch.column(1).to_numpy(zero_copy_only=False)
                q = s.queries(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                wanted, first = s.probes(q, k, share)
                # Rows under the query's own id are no candidates, but the sample may hold them.
                limit = np.where(own != NONE, 8.0, s.limits(q, k))
                start = np.zeros(wanted.shape, bool)
                start[np.arange(len(q)), first] = True
                pad = layout.groups * layout.per - wanted.shape[1]
                masks = [(np.pad(m, ((0, 0), (0, pad))).reshape(len(q), layout.groups, layout.per) * bits).sum(2) for m in (start, wanted & ~start, ~wanted)]
                row, group = np.nonzero(np.ones((len(q), layout.groups), bool))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in range(3)] + [pa.array(limit[row]), pa.array(group.astype(np.int32)), *(pa.array(m[row, group]) for m in masks)], ["qcls", "own", "v", "limit", "group", "first", "lists", "others"])

    return queries.select("qcls", "own", "v").mapInArrow(probed, "qcls bigint, own bigint, v array<double>, limit double, group int, first bigint, lists bigint, others bigint")


def _search(index: DataFrame, asked: DataFrame, space, layout: Layout, k: int) -> DataFrame:
    """qcls, own, cls, low, score of each chunk, the best k + 1 of each query that probes its list (`lists`); `limit` bounds squared distances."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for batch in batches:
            for n in range(batch.num_rows):
                slot = batch.column(0)[n].as_py()
                lists, qcls, own, qdata, limit, cls, low, next_, data, turned = (batch.column(c).slice(n, 1).flatten().to_numpy(zero_copy_only=False) for c in range(1, 11))
                asks = np.flatnonzero(lists >> slot & 1)
                if not len(asks):
                    continue
                qv, xv = qdata.reshape(len(qcls), -1)[asks], data.reshape(len(cls), -1)
                i, j, left = scan(s.queries(qv), turned.reshape(len(cls), -1), limit[asks].astype(np.float32))
                mine, theirs = own[asks], other_ids(own[asks][i], low[j], next_[j])
                i, j, left, theirs = (x[theirs != NONE] for x in (i, j, left, theirs))
                order = np.lexsort((left, i))
                i, j, theirs = i[order], j[order], theirs[order]
                place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(asks)))[i]
                i, j, theirs = (x[place < k + 1 + SPARE] for x in (i, j, theirs))
                score = np.einsum("ij,ij->i", qv[i], xv[j])
                yield pa.RecordBatch.from_arrays([pa.array(qcls[asks][i]), pa.array(mine[i]), pa.array(cls[j]), pa.array(theirs), pa.array(score)], ["qcls", "own", "cls", "low", "score"])

    spread = asked.where("lists <> 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(layout.pieces - 1))))
    count = spread.groupBy("group", "piece").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(QUERY_CHUNK))).cast("int").alias("chunks"))
    cut = spread.join(count, ["group", "piece"]).withColumn("chunk", F.pmod(F.xxhash64("qcls", "own"), F.col("chunks")).cast("int"))
    q = cut.groupBy("group", "piece", "chunk").agg(F.collect_list(F.struct("lists", "qcls", "own", "v", "limit")).alias("rows"))
    q = q.select("group", "piece", *[F.col("rows")[c].alias(c) for c in ("lists", "qcls", "own")], F.flatten(F.col("rows")["v"]).alias("qv"), F.col("rows")["limit"].alias("limit"))
    tasks = max(12, 2 * q.sparkSession.sparkContext.defaultParallelism)
    n = min(max(tasks, layout.groups * layout.pieces), 20_000)
    both = q.repartition(n, "group", "piece").join(index.repartition(n, "group", "piece"), ["group", "piece"])
    return both.select("slot", "lists", "qcls", "own", "qv", "limit", "cls", "low", "next_", "v", "turned").mapInArrow(found, "qcls bigint, own bigint, cls bigint, low bigint, score double")


def nearest(table: DataFrame, k: int = K, *, id_col: str = "vec_id", vec_col: str = "embedding", share: float = SHARE, per_list: int = PER_LIST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by 20, the k nearest found among all other rows.

    Rows without an id, or whose vector is null, empty, zero or holds null or
    non-finite components, take no part, nor do vectors of another length than
    the commonest. A query whose probed lists hold no k candidates gets them from
    all lists; a table of fewer rows gives fewer, an empty one none. Ties go to
    the smaller id. Repeated rows count once. Rows that share an id with the
    query are no candidates; where a query id has several vectors, its list holds
    the best of all their scores. Only the two named columns are read, so others
    may have any name.
    """
    spark = table.sparkSession
    ship(spark)
    rows = checkpoint(valid(table, id_col, vec_col).where(F.exists("v", lambda x: x != 0)))
    dim = commonest_length(rows)
    if dim is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == dim)
    members = classes(rows, k)
    largest = F.array_max(F.transform("v", F.abs))
    length = largest * F.sqrt(F.aggregate(F.transform("v", lambda x: x / largest), F.lit(0.0), lambda a, x: a + x * x))
    n, most = members.agg(F.count("*"), F.max(length)).first()
    rng = np.random.default_rng(SEED)
    space = Space(dim, float(most) * (1 + 1e-12), rng)
    lists = int(min(MOST_LISTS, max(1, n // per_list)))
    sample = chosen(members.select("low", "v"), "low", min(MOST_SAMPLE, max(SAMPLE, PER_CENTROID * lists)), "ann").select("v").toArrow().column(0).combine_chunks()
    space.fit(sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1), min(lists, len(sample)), n, rng)
    held = spark.sparkContext.broadcast(space)
    layout = Layout(len(space.centroids), n, max(12, 2 * spark.sparkContext.defaultParallelism))
    index = checkpoint(_indexed(members, held, layout))
    asked = query_rows(rows, members)
    queries = checkpoint(_probed(distinct_queries(asked), held, layout, k + 1, share))
    keys, beyond = ["qcls", "own"], F.lit(None).cast("binary").alias("beyond")
    first = checkpoint(_search(index, queries.withColumn("lists", F.col("first")), held, layout, k))
    ranked = first.withColumn("rank_", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "low"))).where(F.col("rank_") <= k + 1)
    best = ranked.groupBy(*keys).agg(F.min("score").alias("score"), F.count("*").alias("n"))
    largest = F.array_max(F.transform("v", F.abs))
    scale = largest * F.sqrt(F.aggregate(F.transform("v", lambda x: x / largest), F.lit(0.0), lambda a, x: a + x * x)) * F.lit(space.most)
    limit = F.when(F.col("n") > k, F.least("limit", 2 - 2 * F.try_divide(F.col("score"), scale))).otherwise(F.col("limit"))
    rest = queries.where("lists <> 0").join(best, keys, "left").withColumn("limit", limit)
    hits = checkpoint(first.unionByName(_search(index, rest, held, layout, k)))
    # Queries that found too few scan what they haven't probed.
    rows_of = hits.join(members.select("cls", F.size("ids").alias("rows")), "cls").groupBy(*keys).agg(F.sum("rows").alias("rows"))
    poor = asked.select(*keys).distinct().join(rows_of, keys, "left").where(F.coalesce("rows", F.lit(0)) <= k).select(*keys)
    if not poor.isEmpty():
        others = queries.join(poor, keys).withColumn("lists", F.col("others")).withColumn("limit", F.lit(8.0))
        again = queries.join(poor, keys).withColumn("lists", F.col("lists").bitwiseOR(F.col("first"))).withColumn("limit", F.lit(8.0))
        hits = hits.unionByName(_search(index, others, held, layout, k)).unionByName(_search(index, again, held, layout, k)).dropDuplicates([*keys, "cls"])
    hits = hits.select(*keys, "cls", "low", "score", beyond)
    return results(merged(hits, members, k), asked.select("vec_id", *keys), k, "double")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
