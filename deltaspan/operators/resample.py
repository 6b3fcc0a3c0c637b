"""Bootstrap of mean differences (BOOT-01 to BOOT-04, AGG-17, AGG-18).

Draws come from (seed, group, replicate, slot), so results don't depend on
partitions or retries. A group's cases are numbered by hash range, then by name.
Groups of up to HELD cases are arrays; larger ones are numbered range by range and
cut into arrays of CHUNK, so no task holds one. Arrays alone travel, to runs of STEP replicates,
whose draws are summed where they arise: each array adds those that fall into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.functions.numeric import PRIME, STRIDE, draw_index, draw_state
from deltaspan.functions.shipping import ship

SEED, N_BOOT = 42, 10_000
#: Cases of a group up to which they form an array, and replicates that one row brings forth at once.
HELD, STEP, RANGES = 200_000, 50, 256
#: Cases in an array of a larger group, and slots whose draws are made at once, in a processor's cache.
CHUNK, SLOTS = 2_000_000, 8192


def _fold(x: np.ndarray, room: np.ndarray, whole: bool = True) -> None:
    """x modulo 2**31 - 1 in place, for x below 2**62; unless `whole`, the prime itself may stand for 0."""
    for _ in range(2):
        np.right_shift(x, 31, out=room)
        x &= PRIME
        x += room
    if whole:
        np.add(x, 1, out=room)
        room >>= 31
        x += room
        x &= PRIME


_STRIDES = np.arange(SLOTS, dtype=np.int64) * STRIDE


def drawn_sum(values: np.ndarray, start: int, n: int, one: int, two: int) -> tuple[float, int]:
    """Of a replicate of n cases: sum and number of the draws that fall on the places from `start` which `values` holds; the draws are those of `draw_place`."""
    total, count, whole = 0.0, 0, start == 0 and len(values) == n
    for at in range(0, n, SLOTS):
        x = _STRIDES[: n - at] + (at * STRIDE + one)
        room = np.empty_like(x)
        _fold(x, room, False)
        y = x * x
        y += two
        _fold(y, room)
        z = y * y
        z += x
        _fold(z, room)
        z *= PRIME
        z += y
        # By a fixed divisor numpy divides faster than it takes remainders.
        np.floor_divide(z, n, out=room)
        room *= n
        z -= room
        if not whole:
            z -= start
            z = z[(z >= 0) & (z < len(values))]
        total += float(values[z].sum())
        count += len(z)
    return total, count


def _replicates(cases: DataFrame, group, n_boot: int, seed: int) -> DataFrame:
    """group_, rep, boot_mean: the mean of as many draws with replacement as the group has cases."""
    rows = cases.where("Diff is not null").select(group.alias("group_"), "LLMScore", "TestCaseId", "Diff", draw_index(F.lit(RANGES), "range", F.col("LLMScore"), F.col("TestCaseId")).alias("range_"))
    sizes = rows.groupBy("group_").agg(F.count("*").alias("n"))
    held = rows.join(sizes.where(F.col("n") <= HELD), "group_").groupBy("group_", "n").agg(F.array_sort(F.collect_list(F.struct("range_", "LLMScore", "TestCaseId", "Diff")))["Diff"].alias("values"))
    return _drawn(held.withColumn("start", F.lit(0).cast("long")).unionByName(_chunks(rows.join(sizes.where(F.col("n") > HELD), "group_"))), n_boot, seed)


def _chunks(rows: DataFrame) -> DataFrame:
    """group_, n, values, start: the arrays of large groups."""
    sizes = rows.groupBy("group_", "range_").agg(F.count("*").alias("size_"))
    starts = sizes.select("group_", "range_", (F.sum("size_").over(W.partitionBy("group_").orderBy("range_")) - F.col("size_")).alias("start_"))
    inside = F.row_number().over(W.partitionBy("group_", "range_").orderBy("LLMScore", "TestCaseId")) - 1
    placed = rows.withColumn("i_", inside).join(starts, ["group_", "range_"]).select("group_", "n", (F.col("start_") + F.col("i_")).cast("long").alias("slot"), "Diff")
    start = F.floor(F.col("slot") / CHUNK).cast("long") * CHUNK
    return placed.groupBy("group_", "n", start.alias("start")).agg(F.array_sort(F.collect_list(F.struct("slot", "Diff")))["Diff"].alias("values"))


def _drawn(arrays: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """group_, rep, boot_mean from arrays: each goes to runs of replicates, to longer ones where it is long."""
    ship(arrays.sparkSession)
    parts = int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.least(F.lit(1000), F.greatest(F.lit(STEP), F.floor(F.size("values") / 2000).cast("int")))
    runs = arrays.withColumn("step_", step).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.col("step_")))).repartition(max(parts, 16), F.col("group_"), F.col("start"), F.col("rep"))
    reps = F.sequence("rep", F.least(F.col("rep") + F.col("step_") - 1, F.lit(n_boot - 1)))
    states = F.transform(reps, lambda r: F.array(*draw_state(seed, F.col("group_"), r)))
    runs = runs.select("group_", "rep", "n", "start", F.flatten(states).alias("states"), "values")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group, rep, n, start = (batch.column(k)[i].as_py() for k in range(4))
                states, values = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (4, 5))
                found = [drawn_sum(values, start, n, int(one), int(two)) for one, two in states.reshape(-1, 2)]
                total, times = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(found), batch.schema.field(0).type), pa.array(range(rep, rep + len(found)), pa.int32()), pa.array(total, pa.float64()), pa.array(times, pa.int64())], ["group_", "rep", "total", "times"])

    found = runs.mapInArrow(sums, f"group_ {runs.schema['group_'].dataType.simpleString()}, rep int, total double, times long")
    return found.groupBy("group_", "rep").agg((F.sum("total") / F.sum("times")).alias("boot_mean"))


def metric_replicates(cases: DataFrame, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """LLMScore, rep, boot_mean."""
    return _replicates(cases, F.col("LLMScore"), n_boot, seed).withColumnRenamed("group_", "LLMScore")


def metric_bootstrap(cases: DataFrame, reps: DataFrame) -> DataFrame:
    """Per metric with a difference: mean_diff, SE, CI_lo_95, CI_hi_95, N_cases."""
    q = F.percentile("boot_mean", F.array(F.lit(0.025), F.lit(0.975)))
    spread = reps.groupBy("LLMScore").agg(F.stddev_samp("boot_mean").alias("SE"), q[0].alias("CI_lo_95"), q[1].alias("CI_hi_95"))
    means = cases.where("Diff is not null").groupBy("LLMScore").agg(F.avg("Diff").alias("mean_diff"), F.count("Diff").alias("N_cases"))
    return means.join(spread, "LLMScore").select("LLMScore", "mean_diff", "SE", "CI_lo_95", "CI_hi_95", "N_cases")


def pooled_replicates(cases: DataFrame, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """rep, boot_mean over all (case, metric) pairs as one group."""
    return _replicates(cases, F.lit("pooled"), n_boot, seed).drop("group_")


def describe(reps: DataFrame) -> DataFrame:
    """count, mean, std, min, p2_5, p50, p97_5, max of the replicates."""
    x = F.col("boot_mean")
    q = F.percentile(x, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return reps.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q[0].alias("p2_5"), q[1].alias("p50"), q[2].alias("p97_5"), F.max(x).alias("max"))
