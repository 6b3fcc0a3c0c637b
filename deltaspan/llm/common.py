"""What the corpus operators share: shipping code, reading tables, splits."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from deltaspan.functions import shipping

#: Bytes of an Arrow batch to Python workers at most: whole texts may be long, and batches are held several times.
ARROW_BYTES = 16 << 20
_SPACE, _SPACE_BYTES = re.compile(r"\s"), re.compile(rb"[\x20\x09-\x0D]")
#: Words everywhere: maximal runs outside the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors and keep Arrow batches small.

    The limit of batches is lowered for the session, never raised: plans read it
    when they run, which is after an operator has returned.
    """
    shipping.ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def spans(text, mark=None, size: int = 1 << 20) -> Iterator:
    """Consecutive parts of a text (str or bytes) of about `size`, cut behind `mark` or, without one, where white space is: words stay whole."""
    if len(text) <= size:
        yield text
        return
    space = _SPACE if isinstance(text, str) else _SPACE_BYTES
    at = 0
    while at < len(text):
        if at + size >= len(text):
            end = len(text)
        elif mark is not None:
            end = text.find(mark, at + size) + 1 or len(text)
        else:
            found = space.search(text, at + size)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; without that setting nothing is written."""
    sc = spark.sparkContext
    # The session's own setting wins: the context's folder is made beneath it.
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def chosen(df: DataFrame, id_col: str, limit: int, seed: str) -> DataFrame:
    """At most `limit` rows, those with the smallest hash of id: the same rows on every run.

    Rows are counted first, and hashes cut so that some twice `limit` rows are
    left, so what tasks send to the driver doesn't grow with their number.
    """
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    n = df.count()
    if n > 2 * limit + 1000:
        kept = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * (2 * limit + 1000) / n))
        df = kept if kept.count() >= limit else df
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), F.col(id_col)).limit(limit)


def with_scores(docs: DataFrame, text_col: str, scores: Callable[[list[str]], np.ndarray], batch: int, keep: list[str] | None = None) -> DataFrame:
    """row_ (the columns `keep`, or all, of each row of `docs` as a struct, whatever their names) and score_ of its whole text (null: empty).

    Texts go to Python once: inside row_ if they are kept there as strings.
    """
    ship(docs.sparkSession)
    names = docs.columns if keep is None else keep
    inside = text_col in names and docs.select(F.col(f"`{text_col}`")).dtypes[0][1] == "string"
    place = names.index(text_col) if inside else 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for at in range(0, full.num_rows, batch):
                part = full.slice(at, batch)
                texts = pc.struct_field(part.column(0), [place]) if inside else part.column(1)
                found = scores([t or "" for t in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["row_", "score_"])

    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_")
    rows = docs.select(row) if inside else docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text_"))
    return rows.mapInArrow(scored, StructType([rows.schema["row_"], StructField("score_", DoubleType())]))


_kept: dict = {}


def worker_cache(key, make: Callable):
    """What a Python worker keeps between tasks: one operator's cache at a time, so that caches don't add up."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give freed memory back to the system, where the C library can: workers outlive the stages of a pipeline."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
