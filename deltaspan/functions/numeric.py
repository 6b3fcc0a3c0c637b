"""Column functions: null-safe arithmetic, keyed random numbers, distribution functions.

Missing results are SQL nulls, never NaN, and nothing here raises under ANSI mode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate, null for constant columns."""
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def near_zero(x: Column, tolerance: float = 1e-8) -> Column:
    return F.coalesce(F.abs(x) <= tolerance, F.lit(False))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, low: Column, high: Column) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounding by plain arithmetic, so that other engines round alike.

    The step lies a little beside the half, where no short decimal fraction falls.
    """
    return F.floor(x * F.lit(float(10**digits)) + F.lit(0.500137)) / F.lit(float(10**digits))


def uniform(*key: Column | int | str) -> Column:
    """In (0, 1), from a hash of the key: the same on every partitioning and retry, and in any engine that has md5."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def draw_index(n: Column, *key: Column | int | str) -> Column:
    """A number from 0 to n - 1 from a hash of the key."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long"), n)


#: A prime below 2**31, so that products of remainders fit 64 bits.
PRIME = 2_147_483_647
#: What neighbouring slots lie apart.
STRIDE = 1_000_003


def draw_state(*key: Column | int | str) -> tuple[Column, Column]:
    """Two numbers below 2**28 from a hash of the key, where a row of draws starts."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 8))


def draw_place(n: Column, state: tuple[Column, Column], slot: Column) -> Column:
    """The slot-th draw from 0 to n - 1: two rounds of squaring modulo a prime, in whole numbers that any engine has."""
    one = (state[0] + slot * F.lit(STRIDE)) % PRIME
    two = (one * one + state[1]) % PRIME
    return ((two * two + one) % PRIME * PRIME + two) % n


def normal(*key: Column | int | str) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    return F.sqrt(-2 * F.log(uniform(*key, "r"))) * F.cos(F.lit(2 * math.pi) * uniform(*key, "a"))


#: Degrees of freedom up to which the finite series is summed.
SERIES = 20_000


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with whole degrees of freedom.

    The finite trigonometric series (Abramowitz and Stegun 26.7.3-4); beyond
    SERIES degrees the normal integral at a transformed t, which agrees there
    to about 1e-9.
    """
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2, sine = F.pow(F.cos(angle), 2), F.sin(angle)
    even = df % 2 == 0
    terms = F.least(F.when(even, (df - 2) / 2).otherwise((df - 3) / 2), F.lit(SERIES / 2)).cast("int")
    one = F.struct(F.lit(0.0).alias("sum"), F.when(even, F.lit(1.0)).otherwise(F.cos(angle)).alias("term"))

    def add(acc: Column, k: Column) -> Column:
        k = k.cast("double")
        ratio = F.when(even, (2 * k + 1) / (2 * k + 2)).otherwise((2 * k + 2) / (2 * k + 3))
        return F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * ratio * c2).alias("term"))

    total = F.aggregate(F.when(terms >= 0, F.sequence(F.lit(0), terms)).otherwise(F.array().cast("array<int>")), one, add, lambda a: a["sum"])
    inside = F.when(df == 1, 2 * angle / math.pi).when(even, sine * total).otherwise((angle + sine * total) * (2 / math.pi))
    d = df.cast("double")
    u = F.least(F.sqrt(d * F.log1p(t * t / d)) * (8 * d + 1) / (8 * d + 3), F.lit(40.0))
    step = u / 800
    simpson = F.aggregate(F.sequence(F.lit(0), F.lit(800)), F.lit(0.0), lambda a, i: a + F.when(i.isin(0, 800), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * F.exp(-F.pow(i * step, 2) / 2))
    far = F.greatest(F.lit(0.0), 1 - 2 * simpson * step / 3 / math.sqrt(2 * math.pi))
    return F.when(t.isNull() | df.isNull() | (df < 1), None).when(df > SERIES, far).otherwise(F.greatest(F.lit(0.0), 1 - inside))


def exact_quantiles(rows: DataFrame, group: list[str], value: str, shares: list[float], name: str) -> DataFrame:
    """group, name: the values' exact quantiles per group, interpolated between neighbours, as an array; null without values.

    No task holds a group: a sketch of bounded size brackets each quantile, and
    only what lies in a bracket, counted by distinct value, is put in order.
    """
    v = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v_"))
    # The sketch's ranks are off by less than n / 4000, so these two enclose the ranks of a share.
    edges = [F.array(*[F.lit(min(1.0, max(0.0, q + d))) for q in shares]) for d in (-1e-3, 1e-3)]
    sketch = v.groupBy(*group).agg(
        F.count("*").alias("n_"), F.min("v_").alias("least_"), F.max("v_").alias("most_"),
        *[F.percentile_approx("v_", e, 4000).alias(f"e{i}_") for i, e in enumerate(edges)],
    )
    each = sketch.select(
        *group, "n_",
        F.posexplode(F.arrays_zip(F.col("e0_").alias("low"), F.col("e1_").alias("high"), F.array(*[F.lit(q) for q in shares]).alias("q"))).alias(
            "place_", "b_",
        ),
        "least_", "most_",
    )
    rank = (F.col("n_") - 1) * F.col("b_.q")
    # Ranks at the very ends lie beside the sketch's first and last values; small groups are held whole.
    few = F.col("n_") <= 10_000
    each = each.select(
        *group, "n_", "place_",
        F.when(few | (F.col("b_.q") <= 2e-3), F.col("least_")).otherwise(F.col("b_.low")).alias("low_"),
        F.when(few | (F.col("b_.q") >= 1 - 2e-3), F.col("most_")).otherwise(F.col("b_.high")).alias("high_"),
        rank.alias("rank_"),
    )
    joined = v.join(each, group) if group else v.crossJoin(F.broadcast(each))
    held = joined.where(F.col("v_") <= F.col("high_")).groupBy(*group, "place_", "rank_", F.when(F.col("v_") >= F.col("low_"), F.col("v_")).alias("v_")).agg(F.count("*").alias("c_"))
    upto = F.sum("c_").over(W.partitionBy(*group, "place_").orderBy(F.asc_nulls_first("v_")).rowsBetween(W.unboundedPreceding, W.currentRow))
    held = held.withColumn("upto_", upto).where("v_ is not null")
    at = lambda r: F.min(F.when(F.col("upto_") > r, F.col("v_")))
    low, high = at(F.floor("rank_")), at(F.ceil("rank_"))
    found = held.groupBy(*group, "place_", "rank_").agg(low.alias("a_"), high.alias("b_")).withColumn("x_", F.col("a_") + (F.col("b_") - F.col("a_")) * (F.col("rank_") - F.floor("rank_")))
    return found.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place_", "x_"))), lambda x: x["x_"]).alias(name))
