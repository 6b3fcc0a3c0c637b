"""What the two searches share: usable vectors, classes of equal vectors, query rows, blocks and results.

Equal vectors form a class that keeps its k + 1 smallest ids, so thousands of
copies are one candidate; more of them can't enter a list of k. Classes have a
number of their own, since ids may repeat.

A query is a row. Usually its id has one vector, and its own row drops out at
the end: a class's list of k + 1 serves all its queries. Where an id has several
vectors, none of them is a candidate for it, so its rows are searched under that
id (`own`), classes without another id are masked, and the rows' lists merge
into one of the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.llm.common import checkpoint

#: Every id divisible by this is a query.
QUERY_MOD = 20
#: No id; it isn't divisible by 20, so no query has it.
NONE = -(1 << 63)


def valid(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v: rows with an id and a vector of finite components; repeated rows count once."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    return table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite(v)).distinct()


def finite(v):
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def commonest_length(rows: DataFrame) -> int | None:
    """The length of most vectors, the shortest of those; None without rows."""
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return None if found is None else found["d"]


def classes(rows: DataFrame, k: int) -> DataFrame:
    """cls, v, ids (the k + 1 smallest), low and next_ (the two smallest, NONE if there is one): one row per distinct vector, checkpointed.

    Ranks are limited inside each task before the shuffle, so copies don't gather.
    """
    rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    kept = rows.withColumn("rank_", rank).where(F.col("rank_") <= k + 1)
    ids = kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return checkpoint(ids.select(F.monotonically_increasing_id().alias("cls"), "v", "ids", F.col("ids")[0].alias("low"), F.coalesce(F.get("ids", F.lit(1)), F.lit(NONE)).alias("next_")))


def query_rows(rows: DataFrame, members: DataFrame) -> DataFrame:
    """vec_id, qcls, own, v of the query rows, checkpointed; own is the id where it has several vectors, else NONE."""
    asked = rows.where(F.col("vec_id") % QUERY_MOD == 0)
    again = asked.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.col("vec_id").alias("own"))
    named = asked.join(members.select("v", F.col("cls").alias("qcls")), "v").join(again, "vec_id", "left")
    return checkpoint(named.select("vec_id", "qcls", F.coalesce("own", F.lit(NONE)).alias("own"), "v"))


def distinct_queries(asked: DataFrame) -> DataFrame:
    return asked.groupBy("qcls", "own").agg(F.first("v").alias("v"))


def other_ids(own: np.ndarray, low: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """The smallest id of each candidate class besides its query's own; NONE if it has no other."""
    return np.where((low == own) & (own != NONE), next_, low)


def blocks(rows: DataFrame, ids: list[str], vec: str, size: int, dtype: str = "<f8") -> DataFrame:
    """part, keys (int64 bytes, a row of `ids` for each vector), data (vectors as `dtype` bytes): one row per `size` rows of a partition."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys: list[np.ndarray] = []
        data: list[np.ndarray] = []
        held, number, part = 0, 0, TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 20) + number], pa.int64()), pa.array([np.concatenate(keys).tobytes()], pa.binary()), pa.array([np.concatenate(data).astype(dtype).tobytes()], pa.binary())],
                ["part", "keys", "data"],
            )

        for full in batches:
            at = 0
            while at < full.num_rows:
                batch = full.slice(at, size - held)
                at += batch.num_rows
                keys.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(len(ids))], axis=1))
                data.append(batch.column(len(ids)).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                held += batch.num_rows
                if held >= size:
                    yield out()
                    keys, data, held, number = [], [], 0, number + 1
        if held:
            yield out()

    return rows.select(*ids, vec).mapInArrow(packed, "part bigint, keys binary, data binary")


def unpack(keys: bytes, data: bytes, columns: int, dtype: str = "<f8") -> tuple[np.ndarray, np.ndarray]:
    """The ids, one array for each of the `columns`, and the vectors."""
    ids = np.frombuffer(keys, np.int64).reshape(-1, columns)
    return ids.T, np.frombuffer(data, dtype).reshape(len(ids), -1)


#: Blocks of either side that meet in one cell at most, on average.
CELL = 8


def paired(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each query block beside each candidate block: qpart, qkeys, qdata (and other columns of queries), part, keys, data.

    Both sides fall into groups of at most some CELL blocks, and a cell is one
    group of each: a block is repeated once for each group of the other side, and
    no cell grows with the table. Smaller tables get smaller groups, as a few
    blocks are much work.
    """
    tasks = max(12, 2 * queries.sparkSession.sparkContext.defaultParallelism)
    n_q, n_c = max(queries.count(), 1), max(candidates.count(), 1)
    groups_q, groups_c = -(-n_q // CELL), -(-n_c // min(CELL, max(1, n_c * -(-n_q // CELL) // tasks)))
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("part"), F.lit(n)).cast("int")
    q = queries.withColumn("group_q", deal(groups_q)).withColumnsRenamed({"part": "qpart", "keys": "qkeys", "data": "qdata"}).withColumn("group_c", across(groups_c))
    c = candidates.withColumn("group_c", deal(groups_c)).withColumn("group_q", across(groups_q))
    n = min(max(tasks, groups_q * groups_c), 20_000)
    return q.repartition(n, "group_q", "group_c").join(c.repartition(n, "group_q", "group_c"), ["group_q", "group_c"])


def results(best: DataFrame, asked: DataFrame, k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score from best (qcls, own, found: (vec_id, score, ...) in order, k + 1 or fewer) and the query rows.

    The query's own row drops out here. Lists of rows that share an id merge.
    """
    found = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    lists = asked.withColumnRenamed("vec_id", "query_id").join(best, ["qcls", "own"]).select("query_id", "own", found.alias("found"))
    one = lists.where(F.col("own") == NONE).select("query_id", F.posexplode("found").alias("pos", "x")).withColumn("rank", (F.col("pos") + 1).cast("int"))
    many = lists.where(F.col("own") != NONE).select("query_id", F.explode("found").alias("x"))
    order = W.partitionBy("query_id").orderBy(F.desc("x.score"), F.desc("x.beyond"), "x.vec_id")
    many = many.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rows = one.select("query_id", "rank", "x").unionByName(many)
    return rows.select("query_id", "rank", F.col("x.vec_id").alias("vec_id"), F.col("x.score").cast(score).alias("score"))


def merged(hits: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """qcls, own, found: of hits (qcls, own, cls, low, score, beyond), the best k + 1 rows, classes spread out to their ids.

    `low` is the class's smallest id other than `own`; `beyond` orders scores
    that are equal. A class outside the best k + 1 by (score, low) can't give a
    row among the best k + 1, so classes are cut first, inside each task already.
    """
    order = W.partitionBy("qcls", "own").orderBy(F.desc("score"), F.desc("beyond"), "low")
    top = hits.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= k + 1).drop("rank_", "low")
    rows = top.join(members.select("cls", "ids"), "cls").select("qcls", "own", "score", "beyond", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("own"))
    order = W.partitionBy("qcls", "own").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    rows = rows.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= k + 1)
    listed = rows.groupBy("qcls", "own").agg(F.array_sort(F.collect_list(F.struct("rank_", "vec_id", "score", "beyond"))).alias("found"))
    return listed.select("qcls", "own", F.transform("found", lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"), x["beyond"].alias("beyond"))).alias("found"))
