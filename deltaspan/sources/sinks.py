"""Writing and showing result tables (SNK-01 to SNK-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORTS = ("per_case_cuped_diff", "metric_cuped_summary_raw", "metric_cuped_summary_bootstrap", "theta_table", "variance_reduction_by_metric", "coverage_by_metric")
#: Tables of one row per metric, which one file holds.
PER_METRIC = frozenset(EXPORTS) - {"per_case_cuped_diff"} | {"row_counts", "metric_baseline_stats", "pooled_bootstrap", "multiple_comparison", "sensitivity", "paired_cuped", "crossfit", "cluster_se", "bars", "pair_coverage", "overall", "rate_difference", "violins", "diagnostics", "fallback"}


def write_csv(df: DataFrame, folder: str, name: str, single: bool = False) -> str:
    """A folder of CSV files with headers; `single` makes one file, for per-metric tables only."""
    path = f"{folder.rstrip('/')}/{name}"
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def export(tables: dict[str, DataFrame], folder: str, names: tuple[str, ...] | None = None) -> dict[str, str]:
    """Tables as CSV, all or those named; tables of one row per metric as one file each, arrays and structs as JSON texts."""
    if names is not None and (missing := sorted(set(names) - set(tables))):
        raise KeyError(f"no tables {missing}")
    return {name: write_csv(_flat(tables[name]), folder, name, single=name in PER_METRIC) for name in (names or tables)}


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in df.schema.fields])


def preview(tables: dict[str, DataFrame], rows: int = 5) -> str:
    """The first rows of each table as text."""
    return "\n".join(f"{name}\n{df._show_string(rows, False, False)}" for name, df in tables.items())
