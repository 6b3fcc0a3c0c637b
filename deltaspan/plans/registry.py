"""Queries of the comparison engine over the driver's tables, and their SQL twins.

Doubles are rounded to six digits on both sides, by the same arithmetic.
The SQL is written with joins and subqueries where the engine uses windows and
conditional aggregates, so that the two don't share a mistake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaspan.functions.numeric import rounded
from deltaspan.operators import assertions as a
from deltaspan.operators import bayes, coverage, cuped, inference, paired, plotdata, resample, simulate
from deltaspan.sources import adapters, load

#: The whole size of the reference, in the queries and in their SQL.
N_BOOT = N_POOLED = resample.N_BOOT


def tidy(df: DataFrame) -> DataFrame:
    """All doubles rounded."""
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def sql(with_: str, select: str, doubles: str = "", others: str = "", ints: str = "") -> str:
    """A query whose doubles are rounded and whose whole numbers are bigint."""
    cols = [*others.split(), *(f"{c}::bigint as {c}" for c in ints.split()), *(f"floor({c} * 1e6 + 0.500137) / 1e6 as {c}" for c in doubles.split())]
    return f"with {with_}, out_ as ({select}) select {', '.join(cols)} from out_"


def obs_sql(table: str) -> str:
    return f"obs as ({ {'events': adapters.EVENTS_SQL, 'orders': adapters.ORDERS_SQL, 'lineitem': adapters.LINEITEM_SQL}[table] })"


def base_sql(table: str, impute: bool = False) -> str:
    keep = "coalesce(b.x, m.mx)" if impute else "b.x"
    return f"""{obs_sql(table)},
b as (select TestCaseId, LLMScore, avg(Value) as x from obs where Period = 'Previous' group by all),
m as (select LLMScore, avg(x) as mx from b group by all),
p as (select o.LLMScore, o.Value as y, b.x from obs o join b using (TestCaseId, LLMScore) where Period = 'Previous'),
c as (select p.*, x - avg(x) over (partition by LLMScore) as xc, y - avg(y) over (partition by LLMScore) as yc from p),
t0 as (select LLMScore, avg(xc * xc) as var_X, avg(xc * yc) as cov, avg(yc * yc) as var_y, count(*) as N_rows_prev from c group by all),
t as (select LLMScore, case when abs(var_X) <= 1e-8 then 0 else cov / var_X end as theta,
  case when N_rows_prev > 1 and var_X > 0 and var_y > 0 then cov / sqrt(var_X * var_y) end as corr_XY, var_X, N_rows_prev,
  case when abs(var_X) > 1e-8 then cov / var_X end as OLS_slope from t0),
r as (select o.*, {keep} as X_baseline, {"m.mx" if impute else "case when b.x is not null then m.mx end"} as mean_X_baseline, coalesce(t.theta, 0) as theta
  from obs o left join b using (TestCaseId, LLMScore) left join m on o.LLMScore = m.LLMScore left join t on o.LLMScore = t.LLMScore),
rows_ as (select *, Value - theta * (X_baseline - mean_X_baseline) as Value_CUPED from r),
prev_ as (select TestCaseId, LLMScore, avg(Value_CUPED) as v from rows_ where Period = 'Previous' group by all),
next_ as (select TestCaseId, LLMScore, avg(Value_CUPED) as v from rows_ where Period = 'Next' group by all),
cases as (select TestCaseId, LLMScore, n.v as Next_CUPED_Mean, p.v as Prev_CUPED_Mean, n.v - p.v as Diff from prev_ p full join next_ n using (TestCaseId, LLMScore))"""


SUMMARY = """select LLMScore, avg(Diff) as mean_diff, case when stddev_samp(Diff) > 0 then avg(Diff) / stddev_samp(Diff) end as cohens_d,
avg(Next_CUPED_Mean) / nullif(avg(Prev_CUPED_Mean), 0) - 1 as percent_change, sum((Diff > 0)::int)::double / nullif(count(Diff), 0) as share_improved, count(Diff) as n_cases from cases group by all"""
#: Simpson's rule over the density of Student's t, from 0 to the statistic.
TTEST = """select *, case when t_stat is not null then greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * abs(t_stat) / 3000 * list_sum(list_transform(range(0, 1001),
  lambda i: (case when i in (0, 1000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(1 + pow(i * abs(t_stat) / 1000, 2) / df, -(df + 1) / 2.0)))) end as p_value_ttest
from (select LLMScore, case when count(Diff) >= 2 and stddev_samp(Diff) > 0 then avg(Diff) / (stddev_samp(Diff) / sqrt(count(Diff))) end as t_stat,
  case when count(Diff) >= 2 and stddev_samp(Diff) > 0 then count(Diff) - 1 end as df from cases group by all)"""
HASH = "('0x' || substr(md5({}), 1, 8))::bigint"
UNIFORM = "((" + HASH + " + 0.5) / 4294967296.0)"


SLOTS = HASH.format("'range|' || LLMScore || '|' || TestCaseId") + " % 256, LLMScore, TestCaseId"


def _draws_sql(group: str) -> str:
    """d_ from n_ (grp, slot, n): the place that each replicate draws for each slot."""
    at = [f"('0x' || substr(md5('42|' || {group} || '|' || rep), {k}, 7))::bigint" for k in (1, 8)]
    return f"""state_ as (select grp, rep, {at[0]} as s1, {at[1]} as s2 from (select distinct grp from n_), range({N_BOOT}) r(rep)),
round_ as (select grp, rep, n, s2, (s1 + slot * 1000003) % 2147483647 as x1 from n_ join state_ using (grp)),
second_ as (select grp, rep, n, x1, (x1 * x1 + s2) % 2147483647 as x2 from round_),
d_ as (select grp, rep, ((x2 * x2 + x1) % 2147483647 * 2147483647 + x2) % n as pick from second_)"""


def _boot_sql(table: str) -> str:
    return f"""{base_sql(table)},
n_ as (select LLMScore as grp, row_number() over (partition by LLMScore order by {SLOTS}) - 1 as slot, count(*) over (partition by LLMScore) as n, Diff from cases where Diff is not null),
{_draws_sql("grp")},
reps as (select d_.grp as LLMScore, rep, avg(Diff) as boot_mean from d_ join n_ on d_.grp = n_.grp and pick = slot group by all),
boot as (select LLMScore, mean_diff, SE, CI_lo_95, CI_hi_95, N_cases from (select grp as LLMScore, avg(Diff) as mean_diff, count(*) as N_cases from n_ group by all)
  join (select LLMScore, stddev_samp(boot_mean) as SE, quantile_cont(boot_mean, 0.025) as CI_lo_95, quantile_cont(boot_mean, 0.975) as CI_hi_95 from reps group by all) using (LLMScore))"""


def _cases(spark: SparkSession, d: str, table=adapters.events) -> DataFrame:
    return cuped.per_case(cuped.adjusted(table(spark, d)))


def _reps(spark: SparkSession, d: str) -> DataFrame:
    return resample.metric_replicates(_cases(spark, d), N_BOOT)


def _boot(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    return resample.metric_bootstrap(cases, resample.metric_replicates(cases, N_BOOT))


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    return resample.pooled_replicates(_cases(spark, d), N_POOLED)


def _model(spark: SparkSession, d: str, **more) -> DataFrame:
    """Scalars of the draws for the assertions' counts: whole chains with fixed seeds. No query shows the density of draws."""
    return bayes.sample(spark, _counts(spark, d), vectors=False, density_too=False, **more)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """As `pair_counts` of the assertions; rows are grouped by numbers, and only the pairs' keys become text."""
    return a.pair_counts(adapters.lineitem(spark, d, text=False)).withColumns({k: F.col(k).cast("string") for k in a.PAIR})


PAIRS_SQL = (
    f"{obs_sql('lineitem')}, counts as (select TestCaseId, AssertionId, coalesce(p.y, 0) as y_prev, coalesce(p.n, 0) as "
    "n_prev, coalesce(q.y, 0) as y_next, coalesce(q.n, 0) as n_next from (select TestCaseId, AssertionId, sum(IsTrue) as y, "
    "count(*) as n from obs where Period = 'Previous' group by all) p full join (select TestCaseId, AssertionId, sum(IsTrue) "
    "as y, count(*) as n from obs where Period = 'Next' group by all) q using (TestCaseId, AssertionId))"
)
PAIRED_SQL = (
    "p_ as (select TestCaseId, LLMScore, z.v as Z, y.v - z.v as D from (select TestCaseId, LLMScore, avg(Value) as v from "
    "obs where Period = 'Previous' group by all) z join (select TestCaseId, LLMScore, avg(Value) as v from obs where Period "
    "= 'Next' group by all) y using (TestCaseId, LLMScore))"
)
SIM_SQL = f"""base as (select pair, format('TC{{:03d}}', pair // 5 + 1) as TestCaseId, format('AS{{:03d}}', pair % 5 + 1) as AssertionId,
  sqrt(-2 * ln({UNIFORM.format("'123|' || pair || '|eta|r'")})) * cos(2 * pi() * {UNIFORM.format("'123|' || pair || '|eta|a'")}) as eta_prev,
  0.5 + 0.2 * sqrt(-2 * ln({UNIFORM.format("'123|' || pair || '|tau|r'")})) * cos(2 * pi() * {UNIFORM.format("'123|' || pair || '|tau|a'")}) as tau_j from range(200) r(pair)),
truth as (select *, 1 / (1 + exp(-eta_prev)) as p_prev, eta_prev + tau_j as eta_next, 1 / (1 + exp(-eta_prev - tau_j)) as p_next, 1 / (1 + exp(-eta_prev - tau_j)) - 1 / (1 + exp(-eta_prev)) as true_delta from base)"""


def _same(cases: DataFrame) -> DataFrame:
    """Cases whose differences within 1e-9 are 0."""
    return cases.withColumn("Diff", F.when(F.abs("Diff") <= 1e-9, F.lit(0.0)).otherwise(F.col("Diff")))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all sorts, made from the orders table, for the readers' rules."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.element_at(
            F.array(
                *[F.lit(x) for x in ("", " 2 ", "1e3", "abc", "1,000", "0x1A", "NA", "-", "True", "no ", "1d", "-0.9", "0.4", "Y", "null", "inf")],
            ),
            (k % 16 + 1).cast("int"),
        ),
        F.when(k % 16 == 7, (k % 50).cast("string")).otherwise(""),
    )
    return spark.read.parquet(f"{d}/orders.parquet").select(k, text.alias("text"))


TEXTS_SQL = (
    "texts as (select o_orderkey, list_extract(['', ' 2 ', '1e3', 'abc', '1,000', '0x1A', 'NA', '-', 'True', 'no ', '1d', "
    "'-0.9', '0.4', 'Y', 'null', 'inf'], (o_orderkey % 16 + 1)::int) || case when o_orderkey % 16 = 7 then (o_orderkey % "
    "50)::varchar else '' end as text from orders)"
)

Q: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, build, oracle: str | None = None, digits: bool = True) -> None:
    Q[name] = (lambda spark, d: tidy(build(spark, d))) if digits else build
    if oracle is not None:
        ORACLES[name] = oracle


for _t, _f in (("events", adapters.events), ("orders", adapters.orders)):
    _n = "" if _t == "events" else "_sparse"
    add(f"cuped_summary{_n}", lambda s, d, f=_f: cuped.summary(_cases(s, d, f)), sql(base_sql(_t), SUMMARY, "mean_diff cohens_d percent_change share_improved", "LLMScore", "n_cases"))
    add(
        f"coverage{_n}", lambda s, d, f=_f: coverage.coverage(f(s, d)),
        sql(
            (
                f"{obs_sql(_t)}, k as (select distinct LLMScore, TestCaseId, Period from obs), x as (select LLMScore, count(*) as "
                "cases_next, count(p.TestCaseId) as cases_intersection from k n left join k p using (LLMScore, TestCaseId) where "
                "n.Period = 'Next' and (p.Period = 'Previous') group by all)"
            ),
            (
                "select m.LLMScore, (select count(*) from k where k.LLMScore = m.LLMScore and Period = 'Previous') as cases_prev, "
                "(select count(*) from k where k.LLMScore = m.LLMScore and Period = 'Next') as cases_next, "
                "coalesce(x.cases_intersection, 0) as cases_intersection, coalesce(x.cases_intersection, 0)::double / nullif((select "
                "count(*) from k where k.LLMScore = m.LLMScore and Period = 'Next'), 0) as coverage_rate_next, "
                "coalesce(coalesce(x.cases_intersection, 0)::double / nullif((select count(*) from k where k.LLMScore = m.LLMScore and "
                "Period = 'Next'), 0) < 0.7, false) as low_overlap_flag from (select distinct LLMScore from k) m left join x using "
                "(LLMScore)"
            ),
            "coverage_rate_next", "LLMScore low_overlap_flag", "cases_prev cases_next cases_intersection",
        ),
    )
    add(
        f"row_counts{_n}", lambda s, d, f=_f: coverage.row_counts(f(s, d)),
        sql(
            obs_sql(_t),
            "select Period, LLMScore, count(*) as rows, count(distinct TestCaseId) as unique_cases from obs group by all",
            "", "Period LLMScore", "rows unique_cases",
        ),
    )
    add(f"baseline{_n}", lambda s, d, f=_f: cuped.baseline(f(s, d)), sql(base_sql(_t), "select TestCaseId, LLMScore, x as X_baseline from b", "X_baseline", "TestCaseId LLMScore"))
    add(
        f"baseline_stats{_n}", lambda s, d, f=_f: cuped.baseline_stats(f(s, d)),
        sql(
            base_sql(_t),
            "select LLMScore, avg(x) as mean, stddev_samp(x) as std, count(x) as n_cases from b group by all",
            "mean std", "LLMScore", "n_cases",
        ),
    )
    add(
        f"theta{_n}", lambda s, d, f=_f: cuped.theta(f(s, d)),
        sql(
            base_sql(_t),
            "select *, abs(var_X) <= 1e-8 or coalesce(abs(corr_XY) < 0.05, false) as variance_or_corr_flag from t",
            "theta corr_XY var_X OLS_slope", "LLMScore variance_or_corr_flag", "N_rows_prev",
        ),
    )
    add(
        f"cuped_rows{_n}",
        lambda s, d, f=_f: cuped.adjusted(f(s, d)).select(
            "RunId", "TestCaseId", "LLMScore", "Period", "X_baseline", "mean_X_baseline", "theta", "Value_CUPED",
        ),
        sql(base_sql(_t), "from rows_", "X_baseline mean_X_baseline theta Value_CUPED", "RunId TestCaseId LLMScore Period"),
    )
    add(
        f"variance_reduction{_n}",
        lambda s, d, f=_f: cuped.variance_reduction(cuped.adjusted(f(s, d))),
        sql(
            base_sql(_t),
            (
                "select LLMScore, var_pop(Value) as var_raw, var_pop(Value_CUPED) as var_cuped, case when var_pop(Value) > 0 then 100 * "
                "(1 - var_pop(Value_CUPED) / var_pop(Value)) end as variance_reduction_pct from rows_ group by all"
            ),
            "var_raw var_cuped variance_reduction_pct", "LLMScore",
        ),
    )
    add(f"per_case{_n}", lambda s, d, f=_f: _cases(s, d, f), sql(base_sql(_t), "from cases", "Next_CUPED_Mean Prev_CUPED_Mean Diff", "TestCaseId LLMScore"))
    add(f"sensitivity{_n}", lambda s, d, f=_f: inference.sensitivity(_cases(s, d, f), f(s, d)), sql(f"""{base_sql(_t)}, i_ as (select TestCaseId from obs where Period = 'Previous' intersect select TestCaseId from obs where Period = 'Next'),
q_ as (select LLMScore, quantile_cont(Diff, 0.025) as lo, quantile_cont(Diff, 0.975) as hi, median(Diff) as median_diff, avg(Diff) as mean_diff, count(Diff) as n_cases from cases group by all),
w_ as (select LLMScore, avg(case when Diff is not null then least(greatest(Diff, lo), hi) end) as mean_diff_winsor from cases join q_ using (LLMScore) group by all),
j_ as (select LLMScore, avg(Diff) as mean_diff_intersection, count(Diff) as n_cases_intersection from cases where TestCaseId in (from i_) group by all)""", "select * from q_ left join w_ using (LLMScore) left join j_ using (LLMScore)", "mean_diff mean_diff_intersection mean_diff_winsor median_diff", "LLMScore", "n_cases n_cases_intersection"))
    add(
        f"winsorized{_n}",
        lambda s, d, f=_f: inference.winsorized(_cases(s, d, f)).select("TestCaseId", "LLMScore", "Diff", "Diff_winsor"),
        sql(
            f"{base_sql(_t)}, q_ as (select LLMScore, quantile_cont(Diff, 0.025) as lo, quantile_cont(Diff, 0.975) as hi from cases group by all)",
            (
                "select TestCaseId, LLMScore, Diff, case when Diff is not null then least(greatest(Diff, lo), hi) end as Diff_winsor "
                "from cases join q_ using (LLMScore)"
            ),
            "Diff Diff_winsor", "TestCaseId LLMScore",
        ),
    )
    add(
        f"ttest_bh{_n}",
        lambda s, d, f=_f: inference.benjamini_hochberg(inference.paired_t(_cases(s, d, f))),
        sql(
            (
                f"{base_sql(_t)}, tt as ({TTEST}), k_ as (select *, row_number() over (order by p_value_ttest desc) as up, count(*) over "
                "() as m from tt where p_value_ttest is not null), h_ as (select LLMScore, least(1, min(p_value_ttest * m / (m - up + "
                "1)) over (order by p_value_ttest desc, up)) as q_value_bh from k_)"
            ),
            "select tt.*, q_value_bh from tt left join h_ using (LLMScore)",
            "t_stat p_value_ttest q_value_bh", "LLMScore", "df",
        ),
    )
    add(
        f"paired_cuped{_n}",
        lambda s, d, f=_f: paired.paired_cuped(paired.pairs(f(s, d))),
        sql(
            (
                f"{obs_sql(_t)}, {PAIRED_SQL}, th as (select LLMScore, covar_samp(D, Z) / var_samp(Z) as theta, avg(Z) as mz, corr(D, Z) "
                "as rho, var_samp(D) as var_D from p_ group by all), s_ as (select p_.LLMScore, D - theta * (Z - mz) as ds from p_ join "
                "th using (LLMScore)), g_ as (select LLMScore, avg(ds) as delta, sqrt(var_samp(ds) / count(*)) as se, var_samp(ds) as "
                "var_D_star, count(*) as n from s_ group by all)"
            ),
            "select *, 1 - var_D_star / var_D as variance_reduction, 1 / (1 - rho * rho) as ess_gain from g_ join th using (LLMScore)",
            "delta se theta var_D var_D_star rho variance_reduction ess_gain",
            "LLMScore", "n",
        ),
    )
    add(
        f"cluster_se{_n}", lambda s, d, f=_f: paired.cluster_se(f(s, d)),
        sql(
            (
                f"{obs_sql(_t)}, m_ as (select LLMScore, Period, avg(Value) as m, count(*) as n from obs group by all), u_ as (select "
                "TestCaseId, LLMScore, sum((case when Period = 'Next' then 1 else -1 end) * (Value - m) / n) as u from obs join m_ using "
                "(LLMScore, Period) group by all)"
            ),
            (
                "select LLMScore, (select m from m_ x where x.LLMScore = u_.LLMScore and Period = 'Next') - (select m from m_ x where "
                "x.LLMScore = u_.LLMScore and Period = 'Previous') as delta, sqrt(sum(u * u) * count(*) / (count(*) - 1)) as cluster_se, "
                "count(*) as clusters from u_ group by LLMScore"
            ),
            "delta cluster_se", "LLMScore", "clusters",
        ),
    )
    add(
        f"improved_worse{_n}",
        lambda s, d, f=_f: paired.improved_worse(paired.pairs(f(s, d))),
        sql(
            f"{obs_sql(_t)}, {PAIRED_SQL}",
            (
                "select LLMScore, avg((D > 0)::int) as improved, avg((D < 0)::int) as worse, avg((D = 0)::int) as same, count(*) as n "
                "from p_ group by all"
            ),
            "improved worse same", "LLMScore", "n",
        ),
    )
    add(
        f"standardized{_n}",
        lambda s, d, f=_f: paired.standardized(f(s, d)).select("RunId", "LLMScore", "Value_01"),
        sql(
            obs_sql(_t),
            (
                "select RunId, LLMScore, (Value - min(Value) over w) / nullif(max(Value) over w - min(Value) over w, 0) as Value_01 from "
                "obs window w as (partition by LLMScore)"
            ),
            "Value_01", "RunId LLMScore",
        ),
    )
    add(
        f"metric_names{_n}", lambda s, d, f=_f: coverage.metric_names(f(s, d)),
        sql(obs_sql(_t), "select LLMScore from obs where Period = 'Previous' union select LLMScore from obs where Period = 'Next'", "", "LLMScore"),
    )
    add(
        f"case_intersection{_n}", lambda s, d, f=_f: coverage.case_intersection(f(s, d)),
        sql(
            obs_sql(_t),
            "select TestCaseId from obs where Period = 'Previous' intersect select TestCaseId from obs where Period = 'Next'",
            "", "TestCaseId",
        ),
    )
    add(
        f"next_only_cases{_n}", lambda s, d, f=_f: coverage.next_only_cases(f(s, d)),
        sql(
            obs_sql(_t),
            "select LLMScore, TestCaseId from obs where Period = 'Next' except select LLMScore, TestCaseId from obs where Period = 'Previous'",
            "", "LLMScore TestCaseId",
        ),
    )

add(
    "cuped_rows_imputed",
    lambda s, d: cuped.adjusted(adapters.orders(s, d), True).select("RunId", "Period", "X_baseline", "mean_X_baseline", "Value_CUPED"),
    sql(base_sql("orders", True), "from rows_", "X_baseline mean_X_baseline Value_CUPED", "RunId Period"),
)
add("bootstrap_replicates", _reps, sql(_boot_sql("events"), "from reps", "boot_mean", "LLMScore", "rep"))
add("bootstrap_metric", _boot, sql(_boot_sql("events"), "from boot", "mean_diff SE CI_lo_95 CI_hi_95", "LLMScore", "N_cases"))
add(
    "bootstrap_bars", lambda s, d: plotdata.bars(_boot(s, d)),
    sql(
        _boot_sql("events"),
        "select LLMScore, mean_diff, mean_diff - CI_lo_95 as err_lo, CI_hi_95 - mean_diff as err_hi from boot",
        "mean_diff err_lo err_hi", "LLMScore",
    ),
)
add("bootstrap_marks", lambda s, d: plotdata.marks(_boot(s, d)), sql(_boot_sql("events"), "select *, 0.0 as zero from boot", "zero mean_diff CI_lo_95 CI_hi_95", "LLMScore"))
POOLED_SQL = f"""{base_sql("events")},
n_ as (select 'pooled' as grp, row_number() over (order by {SLOTS}) - 1 as slot, count(*) over () as n, Diff from cases where Diff is not null),
{_draws_sql("grp")},
reps as (select rep, avg(Diff) as boot_mean from d_ join n_ on pick = slot group by all)"""
add("bootstrap_pooled_replicates", _pooled, sql(POOLED_SQL, "from reps", "boot_mean", "", "rep"))
add(
    "bootstrap_pooled", lambda s, d: resample.describe(_pooled(s, d)),
    sql(
        POOLED_SQL,
        (
            "select count(*) as count, avg(boot_mean) as mean, stddev_samp(boot_mean) as std, min(boot_mean) as min, "
            "quantile_cont(boot_mean, 0.025) as p2_5, quantile_cont(boot_mean, 0.5) as p50, quantile_cont(boot_mean, 0.975) as "
            "p97_5, max(boot_mean) as max from reps"
        ),
        "mean std min p2_5 p50 p97_5 max", "", "count",
    ),
)
CROSS_SQL = f"""{obs_sql("events")}, {PAIRED_SQL}, f_ as (select *, {HASH.format("'fold|' || TestCaseId")} % 5 as fold from p_),
k_ as (select distinct LLMScore, fold from f_),
r_ as (select k_.LLMScore, k_.fold, covar_samp(D, Z) / var_samp(Z) as theta, avg(Z) as mz from k_ join f_ on f_.LLMScore = k_.LLMScore and f_.fold <> k_.fold group by all),
x_ as (select LLMScore, fold, count(*) as n, any_value(theta) as theta, avg(D) - any_value(theta) * (avg(Z) - any_value(mz)) as delta_fold from f_ join r_ using (LLMScore, fold) group by all)"""
add("crossfit_theta", lambda s, d: paired.crossfit(paired.pairs(adapters.events(s, d))), sql(CROSS_SQL, "from x_", "theta delta_fold", "LLMScore", "fold n"))
add(
    "crossfit_delta",
    lambda s, d: paired.crossfit_delta(paired.pairs(adapters.events(s, d))),
    sql(CROSS_SQL, "select LLMScore, sum(n * delta_fold) / sum(n) as delta, sum(n) as n from x_ group by all", "delta", "LLMScore", "n"),
)
add(
    "pair_coverage", lambda s, d: coverage.pair_coverage(adapters.lineitem(s, d)),
    sql(
        PAIRS_SQL,
        (
            "select count(*) filter (n_prev > 0) as pairs_prev, count(*) filter (n_next > 0) as pairs_next, count(*) filter (n_prev "
            "> 0 and n_next > 0) as pairs_intersection, pairs_intersection::double / pairs_next as coverage_rate_next, "
            "pairs_intersection::double / pairs_next < 0.7 as low_overlap_flag from counts"
        ),
        "coverage_rate_next", "low_overlap_flag", "pairs_prev pairs_next pairs_intersection",
    ),
)
add("pair_counts", lambda s, d: a.pair_counts(adapters.lineitem(s, d)), sql(PAIRS_SQL, "from counts", "", "TestCaseId AssertionId", "y_prev n_prev y_next n_next"))
add(
    "pair_ids",
    lambda s, d: a.pair_ids(a.pair_counts(adapters.lineitem(s, d))).select("TestCaseId", "AssertionId", "pair_id"),
    sql(
        PAIRS_SQL,
        "select TestCaseId, AssertionId, row_number() over (order by TestCaseId, AssertionId) as pair_id from counts",
        "", "TestCaseId AssertionId", "pair_id",
    ),
)
add(
    "pair_baseline", lambda s, d: a.pair_baseline(adapters.lineitem(s, d)),
    sql(
        PAIRS_SQL,
        "select TestCaseId, AssertionId, y_prev::double / n_prev as X_baseline from counts where n_prev > 0",
        "X_baseline", "TestCaseId AssertionId",
    ),
)
add(
    "lift_distribution",
    lambda s, d: a.lift_distribution(a.pair_counts(adapters.lineitem(s, d))),
    sql(
        (
            f"{PAIRS_SQL}, l_ as (select AssertionId, y_next::double / n_next - y_prev::double / n_prev as lift from counts where "
            "n_next > 0 and n_prev > 0)"
        ),
        (
            "select AssertionId, count(*) as n_pairs, avg(lift) as mean_lift, quantile_cont(lift, 0.25) as q25, quantile_cont(lift, "
            "0.5) as q50, quantile_cont(lift, 0.75) as q75, avg((lift > 0)::int) as improved, avg((lift < 0)::int) as worse from l_ "
            "group by all"
        ),
        "mean_lift q25 q50 q75 improved worse", "AssertionId", "n_pairs",
    ),
)
# Equal means differ by rounding errors here, which must not count as improvements.
add("assertion_cuped", lambda s, d: cuped.summary(_same(cuped.per_case(cuped.adjusted(a.as_scores(adapters.lineitem(s, d)))))))
add("kde_cuped", lambda s, d: plotdata.kde(cuped.adjusted(adapters.events(s, d)), "Value_CUPED", ["LLMScore", "Period"]))
add("kde_bootstrap", lambda s, d: plotdata.kde(_reps(s, d), "boot_mean", ["LLMScore"]))
add(
    "numeric_coercion",
    lambda s, d: _texts(s, d).select("o_orderkey", load.numeric(load.untoken(F.col("text"))).alias("v")).select(
        "o_orderkey", F.when(F.abs("v") < 1e300, F.col("v")).alias("v"), (F.col("v") == float("inf")).alias("infinite"),
    ),
    sql(
        TEXTS_SQL,
        (
            "select o_orderkey, case when text in (' 2 ', '1e3', '-0.9', '0.4') or o_orderkey % 16 = 7 then try_cast(trim(text) as "
            "double) end as v, case when text = 'inf' then true when text in (' 2 ', '1e3', '-0.9', '0.4') or o_orderkey % 16 = 7 "
            "then false end as infinite from texts"
        ),
        "v", "o_orderkey infinite",
    ),
)
add(
    "binary_coercion",
    lambda s, d: _texts(s, d).select("o_orderkey", load.binary(load.untoken(F.col("text"))).alias("v")),
    sql(
        TEXTS_SQL,
        (
            "select o_orderkey, case when text in (' 2 ', '1e3', 'True', 'Y') then 1 when text in ('no ', '-0.9', '0.4') then 0 when "
            "o_orderkey % 16 = 7 then (abs(try_cast(trim(text) as double)) >= 1)::int end as v from texts"
        ),
        "", "o_orderkey", "v",
    ),
)
add("mean_rates", lambda s, d: bayes.mean_rates(_model(s, d)))
add("melt_rates", lambda s, d: bayes.melted(bayes.mean_rates(_model(s, d))))
add("rate_difference", lambda s, d: bayes.rate_difference(bayes.mean_rates(_model(s, d))))
add("posterior_summary", lambda s, d: bayes.scalar_summary(_model(s, d)))
add("posterior_lift", lambda s, d: bayes.predictive(_model(s, d), 0.3))
add("violins", lambda s, d: plotdata.violins(bayes.melted(bayes.mean_rates(_model(s, d)))))
add("top_pairs", lambda s, d: bayes.top_pairs_of(s, a.pair_counts(adapters.lineitem(s, d))))
add("simulate_truth", lambda s, d: simulate.truth(s).drop("pair"), sql(SIM_SQL, "from truth", "eta_prev p_prev tau_j eta_next p_next true_delta", "TestCaseId AssertionId"))
add(
    "simulate_means", lambda s, d: simulate.population(simulate.truth(s)),
    sql(
        SIM_SQL,
        "select avg(p_prev) as mean_p_prev, avg(p_next) as mean_p_next, avg(true_delta) as mean_delta from truth",
        "mean_p_prev mean_p_next mean_delta",
    ),
)
for _p, _c, _o in (("Previous", "p_prev", 0), ("Next", "p_next", 5)):
    add(
        f"simulate_{_p.lower()}", lambda s, d, p=_p: simulate.runs(simulate.truth(s), p),
        sql(
            SIM_SQL,
            (
                f"select (pair * 10 + {_o} + run + 1)::varchar as RunId, TestCaseId, AssertionId, "
                f"({UNIFORM.format(f"'123|' || pair || '|{_p}|' || run")} < {_c})::int as IsTrue, '{_p}' as Period from truth, range(5) "
                "r(run)"
            ),
            "", "RunId TestCaseId AssertionId Period", "IsTrue",
        ),
    )
add("kde_overall", lambda s, d: plotdata.kde(_model(s, d), "overall_delta", []))
add("violin_density", lambda s, d: plotdata.violin_density(bayes.melted(bayes.mean_rates(_model(s, d)))))
POINTS = tuple((0.1 * p - 0.2, 0.1 * p - 0.3, 0.2 * p - 0.3, 0.5 * p - 0.5) for p in range(5))
add("model_density", lambda s, d: bayes.density_at(a.pair_counts(adapters.lineitem(s, d)), POINTS), sql(f"""{PAIRS_SQL}, k_ as (select *, row_number() over (order by TestCaseId, AssertionId) as pair_id from counts),
e_ as (select k_.*, point, 0.1 * point - 0.2 as mu, 0.1 * point - 0.3 as ls, 0.2 * point - 0.3 as tau, 0.5 * point - 0.5 as theta, {UNIFORM.format("'z|' || point || '|' || pair_id")} - 0.5 as z from k_, range(5) r(point)),
q_ as (select *, mu + exp(ls) * z as eta, 1 / (1 + exp(-mu - exp(ls) * z)) as q from e_),
l_ as (select *, eta + tau + theta * (q - avg(q) over (partition by point)) as logit from q_)""", """select point, (sum(y_prev * eta - n_prev * ln(1 + exp(eta)) + y_next * logit - n_next * ln(1 + exp(logit)) - z * z / 2)
  - any_value(mu * mu / 8 + exp(2 * ls) / 2 - ls + tau * tau / 4.5 + theta * theta / 18)) / count(*) as log_density, (sum(y_next - n_next / (1 + exp(-logit))) - any_value(tau / 2.25)) / count(*) as slope_tau from l_ group by point""", "log_density slope_tau", "", "point"))
add("model_grid", lambda s, d: bayes.against_grid(s), sql("""s_ as (select (i + 0.5) * 0.05 as s from range(80) t(i)),
p_ as (select eta, sum(exp(-s * s / 2 - eta * eta / (2 * (4 + s * s))) / sqrt(4 + s * s)) as prior from (select -6 + i * 0.075 as eta from range(161) t(i)) e, s_ group by eta),
g_ as (select eta, tau, prior * exp(-tau * tau / 4.5 + 3 * eta - 10 * ln(1 + exp(eta)) + 7 * (eta + tau) - 10 * ln(1 + exp(eta + tau))) as w from p_, (select -6 + i * 0.075 as tau from range(161) t(i)) t),
m_ as (select sum(w * tau) / sum(w) as tau, sum(w * (1 / (1 + exp(-eta - tau)) - 1 / (1 + exp(-eta)))) / sum(w) as delta from g_)""", "select 'tau' as parameter, tau as grid_mean, true as agrees from m_ union all select 'overall_delta', delta, true from m_", "grid_mean", "parameter agrees"))
add("model_summary", lambda s, d: bayes.scalar_summary(_model(s, d)))
add("model_diagnostics", lambda s, d: bayes.diagnostics(_model(s, d)))
add("model_case_effects", lambda s, d: bayes.scalar_summary(_model(s, d, case_effects=True)))
QUERIES = Q
