"""Both analyses from files or tables to named result tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from deltaspan.operators import assertions as a
from deltaspan.operators import bayes, coverage, cuped, inference, paired, plotdata, resample
from deltaspan.sources import load, sinks


@dataclass(frozen=True)
class Config:
    n_boot: int = 10_000
    seed: int = 42
    impute_missing_baseline: bool = False
    chains: int = 4
    draws: int = 1000
    warmup: int = 500
    top_k: int = 30
    #: Tables that `export_scores` writes.
    names: tuple[str, ...] = field(default=sinks.EXPORTS)


def run_scores(previous: DataFrame, following: DataFrame, c: Config = Config()) -> dict[str, DataFrame]:
    """All tables of the comparison of scores; the adjusted rows and the cases are kept for reuse and may spill."""
    obs = load.tagged(previous, following)
    rows = cuped.adjusted(obs, c.impute_missing_baseline).persist(StorageLevel.MEMORY_AND_DISK)
    cases = cuped.per_case(rows).persist(StorageLevel.MEMORY_AND_DISK)
    reps = resample.metric_replicates(cases, c.n_boot, c.seed)
    boot = resample.metric_bootstrap(cases, reps)
    pairs = paired.pairs(obs)
    return {
        "per_case_cuped_diff": cases,
        "metric_cuped_summary_raw": cuped.summary(cases),
        "metric_cuped_summary_bootstrap": boot,
        "theta_table": cuped.theta(obs),
        "variance_reduction_by_metric": cuped.variance_reduction(rows),
        "coverage_by_metric": coverage.coverage(obs),
        "row_counts": coverage.row_counts(obs),
        "metric_baseline_stats": cuped.baseline_stats(obs),
        "pooled_bootstrap": resample.describe(resample.pooled_replicates(cases, c.n_boot, c.seed)),
        "multiple_comparison": boot.join(inference.benjamini_hochberg(inference.paired_t(cases)), "LLMScore", "left"),
        "sensitivity": inference.sensitivity(cases, obs),
        "paired_cuped": paired.paired_cuped(pairs),
        "crossfit": paired.crossfit_delta(pairs),
        "cluster_se": paired.cluster_se(obs),
        "bars": plotdata.bars(boot),
        "kde_cuped": plotdata.kde(rows, "Value_CUPED", ["LLMScore", "Period"]),
        "kde_bootstrap": plotdata.kde(reps, "boot_mean", ["LLMScore"]),
    }


def export_scores(tables: dict[str, DataFrame], folder: str, c: Config = Config()) -> dict[str, str]:
    """The tables of `run_scores` that the settings name, as CSV."""
    return sinks.export(tables, folder, c.names)


def run_assertions(spark: SparkSession, previous: DataFrame, following: DataFrame, c: Config = Config()) -> dict[str, DataFrame]:
    """All tables of the comparison of assertions; draws are kept for reuse."""
    obs = load.tagged(previous, following)
    counts = a.pair_counts(obs).persist(StorageLevel.MEMORY_AND_DISK)
    draws = bayes.sample(spark, counts, c.chains, c.draws, c.warmup, c.seed).persist(StorageLevel.MEMORY_AND_DISK)
    rates = bayes.mean_rates(draws)
    summary = bayes.pair_summary(draws, counts)
    melted = bayes.melted(rates)
    return {
        "pair_coverage": coverage.pair_coverage(obs),
        "pair_baseline": a.pair_baseline(obs),
        "pair_counts": counts,
        "draws": draws,
        "overall": bayes.scalar_summary(draws),
        "mean_rates": rates,
        "rate_difference": bayes.rate_difference(rates),
        "pair_summary": summary,
        "forest": plotdata.forest(summary, c.top_k),
        "violins": plotdata.violins(melted),
        "violin_density": plotdata.violin_density(melted),
        "kde_overall": plotdata.kde(draws, "overall_delta", []),
        "diagnostics": bayes.diagnostics(draws),
        "lift_distribution": a.lift_distribution(counts),
        "fallback": cuped.summary(cuped.per_case(cuped.adjusted(a.as_scores(obs)))),
    }
