"""Exact top-k inner products in three phases with a uniform threshold.

The columns are cut into `lists`; a candidate's score is the sum of one partial
score per list, and blocks of candidates hold their part of every list. Vectors
are dealt to blocks by descending length.

1. Each block gives the best k + 1 entries of each list among its HEAD longest
   vectors. Their scores, completed in the block, are gathered; the (k + 1)-th
   best over all blocks is a cutoff that no member of the result lies below.
2. The cutoffs go back to all blocks. A block whose longest vector can't reach a
   query's cutoff is skipped for it. Elsewhere a candidate at or above the cutoff
   has at least one partial of cutoff/lists or more, so the entries from that
   uniform threshold on are sufficient. A list that doesn't show a candidate adds
   less than the threshold, which sorts out those that can't reach the cutoff.
3. What the lists left open is computed for the remaining candidates, and the
   best k are taken by exact score and smallest id.

Vectors become floor(64 x) first, so scores are whole numbers. The columns'
ranges decide how they are computed: exactly in single precision below 2**23 and
in double precision below 2**52; beyond that, products in double precision with
a bound of their error give cutoffs and candidates, and what remains is resolved
in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.llm.common import checkpoint, ship
from deltaspan.llm.vectors import CELL, NONE, blocks, classes, commonest_length, distinct_queries, finite, merged, other_ids, paired, query_rows, results, unpack, valid

K, LISTS, BLOCK, QUERY_BLOCK = 20, 2, 4096, 8192
#: Longest vectors of a block that the first phase looks at, at least.
HEAD = 512
#: Queries and candidates whose scores are held at once: some arrays of 2 MB.
TILE = (256, 2048)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def cut(dim: int, lists: int) -> list[slice]:
    edges = np.linspace(0, dim, min(lists, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def tiles(n_queries: int, n: int) -> Iterator[tuple[slice, slice]]:
    for i in range(0, n_queries, TILE[0]):
        for j in range(0, n, TILE[1]):
            yield slice(i, min(i + TILE[0], n_queries)), slice(j, min(j + TILE[1], n))


#: What products of scaled vectors may lose to underflow.
TINY = 1e-300


class Scaled:
    """Vectors for the products: themselves or, where scores may need more than 52 bits, scaled by powers of two.

    Each query then has a scale of its own, at which its largest component is
    about one; candidates share one that keeps products finite. `error` times the
    lengths of a query and a candidate, and TINY, bound the error of a product.
    """

    def __init__(self, dim: int, exponent: int | None):
        self.exponent = exponent
        self.error = 0.0 if exponent is None else (dim + 8) * 2.0**-51

    def queries(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors and their lengths, rounded up."""
        return self._with_lengths(v if self.exponent is None else np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None]))

    def candidates(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._with_lengths(v if self.exponent is None else np.ldexp(v, -max(0, self.exponent - 900)))

    def _with_lengths(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.maximum(np.abs(x).max(1), 1.0 if self.exponent is None else 1e-300).astype(np.float64)
        part = x / most[:, None]
        return x, most * np.sqrt(np.einsum("ij,ij->i", part, part)) * (1 + 1e-6)

    def slack(self, q_length: np.ndarray, x_length: np.ndarray) -> np.ndarray | float:
        return self.error * q_length * x_length + TINY if self.error else 0.0


def list_heads(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of at least the best k entries of each row (all, if fewer).

    The k-th largest of the maxima of 32-entry chunks is a value that k entries reach.
    """
    n = p.shape[1]
    whole = n // 32 * 32
    if whole // 32 <= k:
        return np.nonzero(np.ones(p.shape, bool)) if n <= k else np.nonzero(p >= np.partition(p, n - k, axis=1)[:, n - k, None])
    chunk = p[:, :whole].reshape(len(p), -1, 32).max(2)
    return np.nonzero(p >= np.partition(chunk, chunk.shape[1] - k, axis=1)[:, chunk.shape[1] - k, None])


def masked(own: np.ndarray, low: np.ndarray, next_: np.ndarray) -> np.ndarray | None:
    """Pairs whose candidate class has no id but the query's own; None where no query asks for it."""
    return (other_ids(own[:, None], low[None, :], next_[None, :]) == NONE) if (own != NONE).any() else None


def first_phase(q: np.ndarray, x: np.ndarray, lists: int, k: int, own: np.ndarray, low: np.ndarray, next_: np.ndarray, scaled: Scaled) -> np.ndarray:
    """Lower bounds of the best k scores of each query among the entries that the lists give; -inf where there are fewer."""
    best = np.full((len(q), k), -np.inf)
    (q, q_length), (x, x_length) = scaled.queries(q), scaled.candidates(x)
    for i, j in tiles(len(q), len(x)):
        parts = [q[i, s] @ x[j, s].T for s in cut(q.shape[1], lists)]
        hidden = masked(own[i], low[j], next_[j])
        if hidden is not None:
            for p in parts:
                p[hidden] = -np.inf
        given = np.zeros(parts[0].shape, bool)
        for p in parts:
            given[list_heads(p, k)] = True
        row, col = np.nonzero(given)
        score = sum(p[row, col].astype(np.float64) for p in parts) - scaled.slack(q_length[i][row], x_length[j][col])
        order = np.lexsort((-score, row))
        row, score = row[order], score[order]
        start = np.searchsorted(row, np.arange(len(given)))
        place = np.arange(len(row)) - start[row]
        top = np.full((len(given), k), -np.inf)
        top[row[place < k], place[place < k]] = score[place < k]
        both = np.concatenate([best[i], top], axis=1)
        best[i] = -np.sort(-both, axis=1)[:, :k]
    return best


def later_phases(q: np.ndarray, x: np.ndarray, lists: int, cutoff: np.ndarray, own: np.ndarray, low: np.ndarray, next_: np.ndarray, scaled: Scaled) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query places, candidate places and scores (with errors) of all candidates that may lie at or above their query's cutoff."""
    (q, q_length), (x, x_length) = scaled.queries(q), scaled.candidates(x)
    # Where no vector of the block is long enough, the query skips it.
    asks = np.flatnonzero(q_length * x_length.max() * (1 + 1e-9) >= cutoff - scaled.slack(q_length, x_length.max()))
    for i, j in tiles(len(asks), len(x)):
        rows = asks[i]
        least = cutoff[rows][:, None] - scaled.slack(q_length[rows][:, None], x_length[j][None, :])
        parts = [q[rows, s] @ x[j, s].T for s in cut(q.shape[1], lists)]
        threshold = (least / len(parts)).astype(parts[0].dtype)
        threshold = np.nextafter(threshold, np.asarray(-np.inf, threshold.dtype))  # rounding may not raise it
        given = parts[0] >= threshold
        for p in parts[1:]:
            given |= p >= threshold
        hidden = masked(own[rows], low[j], next_[j])
        if hidden is not None:
            given &= ~hidden
        row, col = np.nonzero(given)
        least, threshold = (np.broadcast_to(m, given.shape)[row, col] for m in (least, threshold))
        each = [p[row, col].astype(np.float64) for p in parts]
        most = sum(np.maximum(e, threshold) for e in each)  # what a list hasn't shown is below the threshold
        open_ = most >= least
        score = sum(each)[open_]
        row, col, least = row[open_], col[open_], least[open_]
        kept = score >= least
        yield rows[row[kept]], col[kept] + j.start, score[kept]


def ordered(n: int) -> bytes:
    """Bytes that sort as whole numbers do."""
    size = (abs(n).bit_length() + 7) // 8
    digits = abs(n).to_bytes(size, "big")
    return b"\x01" + size.to_bytes(4, "big") + digits if n >= 0 else b"\x00" + bytes(255 - b for b in size.to_bytes(4, "big") + digits)


def resolved(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[bytes | None]]:
    """Exact scores, those beyond 64 bits cut to the largest or smallest such number, with bytes that order the cut ones."""
    whole_q, whole_x = ({n: [int(a) for a in v[n]] for n in np.unique(at)} for v, at in ((q, i), (x, j)))
    exact = [sum(map(int.__mul__, whole_q[a], whole_x[b])) for a, b in zip(i.tolist(), j.tolist())]
    return [min(max(n, LEAST), MOST) for n in exact], [ordered(n) if n <= LEAST or n >= MOST else None for n in exact]


def floored(x):
    """floor as a double; from 2**53 on doubles are whole numbers."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)


def top_k(table: DataFrame, k: int = K, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by 20, the k highest scores among all other rows.

    Rows without an id, or whose vector is null, empty or holds null or
    non-finite components, take no part, nor do those that the scale makes
    infinite; vectors of another length than the commonest (the shortest of
    those) take none either. Fewer candidates than k give fewer rows, an empty
    table none; ties go to the smaller id. Repeated rows count once. Rows that
    share an id with the query are no candidates; where a query id has several
    vectors, its list holds the best of all their scores. A score beyond 64 bits
    is given as the largest or smallest such number, in the order of what it is.
    Only the two named columns are read, so others may have any name.
    """
    ship(table.sparkSession)
    rows = valid(table, id_col, vec_col).withColumn("v", F.transform("v", lambda x: floored(x * F.lit(scale)))).where(finite(F.col("v")))
    rows = checkpoint(rows.distinct())
    dim = commonest_length(rows)
    if dim is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    rows = rows.where(F.size("v") == dim)
    # Ranges of the columns: one row for each.
    bounds = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.max(F.abs("x")).alias("x")).collect()
    with np.errstate(over="ignore"):
        most = float((np.array([r["x"] for r in bounds]) ** 2).sum())
    kind = "<f4" if most < 2.0**23 else "<f8"
    scaled = Scaled(dim, None if most < 2.0**52 else int(np.frexp(max(r["x"] for r in bounds))[1]))
    members = classes(rows, k)
    asked = query_rows(rows, members)
    queries = checkpoint(blocks(distinct_queries(asked).coalesce(max(1, -(-asked.count() // QUERY_BLOCK))), ["qcls", "own"], "v", QUERY_BLOCK, kind))
    # The longest vectors stand together; squares of huge components stay finite by the scale.
    unit = F.lit(2.0 ** -max(0, (scaled.exponent or 0) - 500))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * unit * (x * unit))
    parts = min(max(1, -(-members.count() // BLOCK)), 4000)
    dealt = members.withColumn("length", length).repartitionByRange(parts, F.desc("length"), "cls").sortWithinPartitions(F.desc("length"), "cls")
    candidates = checkpoint(blocks(dealt, ["cls", "low", "next_"], "v", BLOCK, kind))
    head = max(HEAD, 4 * (k + 1))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}  # of the query blocks that a task meets again with its next candidates

        def out() -> Iterator[pa.RecordBatch]:
            for qkeys, found in best.items():
                keys = np.frombuffer(qkeys, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), k + 1).cast(pa.list_(pa.float64()))], ["qcls", "own", "best"])
            best.clear()

        for batch in batches:
            for qkeys, qdata, keys, data in zip(*(batch.column(n).to_pylist() for n in range(4))):
                ((_, own), q), ((_, low, next_), x) = unpack(qkeys, qdata, 2, kind), unpack(keys, data, 3, kind)
                found = first_phase(q, x[:head], lists, k + 1, own, low[:head], next_[:head], scaled)
                if qkeys in best:
                    found = -np.sort(-np.concatenate([best[qkeys], found], axis=1), axis=1)[:, : k + 1]
                elif len(best) >= 2 * CELL:
                    yield from out()
                best[qkeys] = np.ascontiguousarray(found)
        yield from out()

    listed = paired(queries, candidates).select("qkeys", "qdata", "keys", "data").mapInArrow(heads, "qcls bigint, own bigint, best array<double>")
    ranked = listed.select("qcls", "own", F.explode("best").alias("bound")).withColumn(
        "rank_",
        F.row_number().over(W.partitionBy("qcls", "own").orderBy(F.desc("bound"))),
    ).where(F.col("rank_") <= k + 1)
    cutoffs = ranked.groupBy("qcls", "own").agg(F.min("bound").alias("cutoff"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, qkeys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.frombuffer(qkeys, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(range(len(keys)), pa.int32())], ["part", "qcls", "own", "place"])

    # Cutoffs travel back as one array per query block.
    placed = queries.select("part", "keys").mapInArrow(places, "part bigint, qcls bigint, own bigint, place int")
    packed = placed.join(cutoffs, ["qcls", "own"]).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "cutoff")))["cutoff"].alias("cutoffs"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qkeys, qdata, keys, data, cutoff in zip(*(batch.column(n).to_pylist() for n in range(5))):
                ((qcls, own), q), ((cls, low, next_), x) = unpack(qkeys, qdata, 2, kind), unpack(keys, data, 3, kind)
                for i, j, score in later_phases(q, x, lists, np.array(cutoff), own, low, next_, scaled):
                    whole, beyond = (score.astype(np.int64), [None] * len(i)) if scaled.exponent is None else resolved(q, x, i, j)
                    yield pa.RecordBatch.from_arrays([pa.array(qcls[i]), pa.array(own[i]), pa.array(cls[j]), pa.array(other_ids(own[i], low[j], next_[j])), pa.array(whole, pa.int64()), pa.array(beyond, pa.binary())], ["qcls", "own", "cls", "low", "score", "beyond"])

    hits = paired(queries.join(packed, "part"), candidates).select("qkeys", "qdata", "keys", "data", "cutoffs").mapInArrow(
        exact,
        "qcls bigint, own bigint, cls bigint, low bigint, score bigint, beyond binary",
    )
    return results(merged(hits, members, k), asked.select("vec_id", "qcls", "own"), k, "bigint")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 20
"""
