"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source gets a target share of all words. A target stops at `max_epochs`
times its source's size and the excess is shared again by weight among the
others, which a running sum over sources in order of size/weight solves at
once. A source gives as many complete epochs as its target holds; the rest is
a weighted sample without replacement: documents in ascending order of
exponential keys -ln(u)/weight, as long as the running sum of sizes, counted to
a document's middle, stays within the rest.

A source may hold a third of all rows, so no source is sorted in one task: keys
are cut into buckets of some hundred rows, running sums go over buckets first
and inside each bucket then, where rows that agree in key, id and size are one
entry with their number. What comes out is one cut per source: the last entry
taken and how many of its rows, so texts are never shuffled or sorted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.llm.common import WORD, checkpoint, checkpoint_dir

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix1"
BUCKET_ROWS = 512


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1 with the share of letters among characters; 0.1 for null or empty texts."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.lit(0.1) + F.lit(0.9) * F.coalesce(F.try_divide(letters.cast("double"), F.length(text).cast("double")), F.lit(0.0))


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u)/weight with u in (0, 1) from the id's hash: the same on every run and partitioning."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((h + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def rows_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None = None) -> DataFrame:
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(
        doc_id.cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        size_of(text).alias("size"),
        (quality_weight(text) if weight is None else F.greatest(weight, F.lit(1e-6))).alias("weight"),
    ).withColumn("key", exponential_key(F.col("doc_id"), F.col("weight")))


def place() -> Column:
    """The order inside a source."""
    return F.struct(F.col("key"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.col("size"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n_rows, mean_weight, target, epochs, rest: one row per source.

    The windows without partitions run over one row per source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"), F.avg("weight").alias("mean_weight"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    given = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sources = sources.withColumn("share", given).withColumn("total", F.sum("source_size").over(every)).withColumn("most", F.col("source_size") * F.lit(max_epochs))
    order = W.orderBy((F.col("most") / F.col("share")).asc(), F.col("source").asc_nulls_last())
    left = F.col("total") - F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = left.cast("double") / F.sum("share").over(order.rowsBetween(0, W.unboundedFollowing))
    sources = sources.withColumn("level", level).withColumn("full", F.col("most").cast("double") <= F.col("level") * F.col("share"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("share"))
    epochs = F.least(F.lit(max_epochs), F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))).cast("long")
    return sources.withColumn("target", target).withColumn("epochs", epochs).select(
        "source", "source_size", "n_rows", "mean_weight", "target", "epochs",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"),
    )


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with `cut` (place, taken, rows): the last place that the fractional selection of a source reaches and
    how many of its equal rows it takes; null if it takes none."""
    numbered = plan.withColumn("buckets", F.ceil(F.col("n_rows") / F.lit(BUCKET_ROWS)))
    p = numbered.where("rest > 0").select(F.col("source").alias("p_source"), "mean_weight", "buckets", "rest")
    r = rows.join(small(p), F.col("source").eqNullSafe(F.col("p_source")), "inner")
    r = r.withColumn("bucket", F.floor(F.col("key") * F.col("mean_weight") * F.col("buckets")))
    r = r.groupBy("source", "bucket", "rest", place().alias("place")).agg(F.count("*").alias("rows")).withColumn("size", F.col("place.size")).withColumn("all_", F.col("size") * F.col("rows"))
    sums = r.groupBy("source", "bucket").agg(F.sum("all_").alias("bucket_size"))
    start = F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("bucket_size")
    sums = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), start.alias("start"))
    inner = F.sum("all_").over(W.partitionBy("source", "bucket").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("all_")
    r = r.withColumn("inner", inner).join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    r = r.withColumn("before", (F.col("start") + F.col("inner")).cast("double"))
    # The j-th of equal rows is taken if its middle, before + (j - 1/2) size, stays within the rest.
    first = F.col("before") + F.col("size") / F.lit(2.0) <= F.col("rest")
    fits = F.floor(F.try_divide(F.col("rest") - F.col("before"), F.col("size").cast("double")) + F.lit(0.5))
    taken = F.when(~first, F.lit(0)).when((F.col("rows") == 1) | (F.col("size") == 0), F.col("rows")).otherwise(F.greatest(F.lit(1), F.least(F.col("rows"), fits)))
    last = r.withColumn("taken", taken.cast("long")).where("taken > 0").groupBy(F.col("source").alias("c_source")).agg(F.max(F.struct("place", "taken", "rows")).alias("cut"))
    return plan.join(last, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")


def copies() -> Column:
    """Complete epochs, and one more up to the cut."""
    return F.col("epochs") + F.coalesce(place() <= F.col("cut.place"), F.lit(False)).cast("long")


def split() -> Column:
    """Rows at the cut of which some are taken and some aren't."""
    return F.coalesce((place() == F.col("cut.place")) & (F.col("cut.taken") < F.col("cut.rows")), F.lit(False))


#: Sources up to which a table of one row each is broadcast; beyond it joins shuffle.
BROADCAST_SOURCES = 50_000


def small(sources: DataFrame) -> DataFrame:
    """The checkpointed table of sources, with a hint if it is as small as it should be."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def plan_mix(rows: DataFrame) -> DataFrame:
    return cuts(rows, checkpoint(targets(rows))).select(F.col("source").alias("m_source"), "source_size", "target", "epochs", "cut")


def mixed_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`.

    Null or empty texts have size 0 and take 0; null sources form a source of
    their own, the last in order; an empty table gives no rows; repeated rows
    stay, and where the cut falls among equal rows as many of them are taken as
    fit. Ties of keys go by id and size. Only the three named columns are read,
    so others may have any name. Texts are read once: what is kept of them is
    checkpointed.
    """
    rows = checkpoint(rows_of(docs, id_col, text_col, source_col))
    mix = small(checkpoint(plan_mix(rows)))
    joined = rows.join(mix, F.col("source").eqNullSafe(F.col("m_source")))
    whole = joined.where(~split()).select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))
    # Equal rows differ in nothing that is returned, so they are counted and dealt out again.
    some = joined.where(split()).groupBy("doc_id", "source", "size", "source_size", "target", "epochs", F.col("cut.taken").alias("more")).agg(F.count("*").alias("rows"))
    each = some.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return whole.unionByName(each.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + (F.col("j") <= F.col("more")).cast("long"))).alias("taken")))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with the columns of `docs`; edge cases as in `mixed_sizes`.

    Rows are written once with their sizes and keys, whose columns alone are
    read for the plan.
    """
    spark = docs.sparkSession
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"),
        F.monotonically_increasing_id().alias("at"), F.col(f"`{id_col}`").alias("i_"), F.col(f"`{text_col}`").alias("t_"),
        F.col(f"`{source_col}`").alias("s_"),
    )
    weight = quality_weight(F.col("t_"))
    held = held.select("row_", "at", F.col("i_").cast("long").alias("doc_id"), F.col("s_").cast("string").alias("source"), size_of(F.col("t_")).alias("size"), weight.alias("weight"))
    path = f"{checkpoint_dir(spark)}/mix_{uuid.uuid4().hex}"
    held.withColumn("key", exponential_key(F.col("doc_id"), F.col("weight"))).write.parquet(path)
    rows = spark.read.parquet(path)
    mix = small(checkpoint(plan_mix(rows.drop("row_", "at"))))
    joined = rows.join(mix, F.col("source").eqNullSafe(F.col("m_source")))
    taken = joined.where(~split()).select("row_", copies().alias("n"))
    # Equal rows at a cut are numbered inside the parts they were written in, and the parts by running sums.
    some = joined.where(split()).withColumn("part", F.shiftright("at", 33))
    parts = some.groupBy(F.col("source").alias("q_source"), F.col("part").alias("q_part")).agg(F.count("*").alias("rows"))
    parts = parts.withColumn("start", F.sum("rows").over(W.partitionBy("q_source").orderBy("q_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("rows")).drop("rows")
    some = some.withColumn("inner", F.row_number().over(W.partitionBy("source", "part").orderBy("at"))).join(parts, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("part") == F.col("q_part")))
    more = (F.col("start") + F.col("inner") <= F.col("cut.taken")).cast("long")
    taken = taken.unionByName(some.select("row_", (F.col("epochs") + more).alias("n"))).where("n > 0")
    return taken.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row_.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ROWS_SQL = r"""
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    -ln((('0x' || substr(md5('mix1|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
      / (0.1 + 0.9 * coalesce(length(regexp_replace(text, '\P{L}+', '', 'g'))::double / nullif(length(text), 0), 0)) as key
  from documents"""

#: Targets by the rule itself: what is above its limit stops there, the rest is shared again, as often as there are sources.
ORACLE = rf"""
with recursive rows_ as ({ROWS_SQL}),
sources as (
  select source, sum(size)::double as s, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from rows_ group by source),
n as (select count(*) as n, sum(s) as total from sources),
fill as (
  select 0 as step, source, s, w, false as full_, total * w / sum(w) over () as target from sources, n
  union all
  select step + 1, source, s, w, target >= 3 * s,
    case when target >= 3 * s then 3 * s
      else (total - sum(case when target >= 3 * s then 3 * s else 0 end) over ()) * w / sum(case when target >= 3 * s then 0 else w end) over () end
  from fill, n where step < n.n),
goal as (
  select fill.source, s, target, least(3, coalesce(floor(target / nullif(s, 0)), 0)) as epochs from fill, n where step = n.n),
placed as (
  select r.*, g.s, g.target, g.epochs, target - epochs * s as rest,
    sum(size) over (partition by r.source order by key, doc_id rows between unbounded preceding and current row) - size / 2 as middle
  from rows_ r join goal g on r.source is not distinct from g.source)
select doc_id, size, s::bigint as source_size, target, (size * (epochs + (middle <= rest)::int))::bigint as taken from placed
"""
