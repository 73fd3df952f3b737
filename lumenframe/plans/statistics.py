"""Queries of agreement, robustness, regression and resampling reports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import measurement as m
from ..operators import resampling as r
from ..sources.tables import table
from .staging import written

REPLICATES = 2000


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Line items as repeated measurements of suppliers, each on one of three devices."""
    return table(spark, d, "lineitem").selectExpr("l_suppkey as patient_id", "l_quantity as reference_value", "l_quantity * (0.95 + l_discount) - l_tax as measurement_value", "concat('D', cast(l_suppkey % 3 as string)) as device_model")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Line items as predictions of prices, with bounds."""
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice as y", "l_quantity * 1500 as p", "l_returnflag as grp", "l_quantity * 1500 - 20000 as lo", "l_quantity * 1500 + 20000 as hi", "12000.0D as u")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id as patient_id", "event_type as perturbation", "value as measurement_value", "event_type as device_model", "cast(ts as date) as session_id").where("measurement_value is not null and patient_id is not null")


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Captures with a finite target: the target against the same target read at another angle and distance."""
    c = table(spark, d, "captures").where("target_value is not null and not isnan(target_value) and patient_id is not null and device_model is not null")
    return c.selectExpr("patient_id", "device_model", "biomarker", "target_value as reference_value", "target_value * (1 + coalesce(incidence_angle_deg, 0) / 1000) - coalesce(working_distance_mm, 0) / 2000 as measurement_value")


def one(df: DataFrame) -> DataFrame:
    return rounded(df)


def measurement_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: agreement of subject means."""
    return one(m.measurement_agreement(measured(spark, d)))


def captures_agreement(spark: SparkSession, d: str) -> DataFrame:
    return one(m.measurement_agreement(captures(spark, d)))


def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return one(m.regression_metrics(predicted(spark, d), "y", "p", model="scaled"))


def bland_altman(spark: SparkSession, d: str) -> DataFrame:
    return one(m.bland_altman(predicted(spark, d), "y", "p"))


def coverage_under_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return one(m.coverage_under_uncertainty(predicted(spark, d), "y", "p", "u"))


def grouped_regression(spark: SparkSession, d: str) -> DataFrame:
    return one(m.grouped_regression(predicted(spark, d), "y", "p", "grp"))


def uncertainty_interval(spark: SparkSession, d: str) -> DataFrame:
    return m.uncertainty_interval(predicted(spark, d), "p", "u").groupBy("grp").agg(F.round(F.avg("lower"), 6).alias("lower"), F.round(F.avg("upper"), 6).alias("upper"))


def subgroup_metrics(spark: SparkSession, d: str) -> DataFrame:
    return one(m.subgroup_metrics(predicted(spark, d), "y", "p", "grp"))


def subgroup_robustness(spark: SparkSession, d: str) -> DataFrame:
    return one(m.subgroup_robustness(measured(spark, d)))


def calibration_transfer(spark: SparkSession, d: str) -> DataFrame:
    return one(m.subgroup_robustness(measured(spark, d).withColumn("calibrated_value", F.expr("1.02 * measurement_value + 0.1")), measurement="calibrated_value"))


def acquisition_perturbation(spark: SparkSession, d: str) -> DataFrame:
    return one(m.acquisition_perturbation(events(spark, d), "view"))


def repeatability(spark: SparkSession, d: str) -> DataFrame:
    """Users' repeats of events; two devices are told apart by whether a user went further than looking."""
    return one(m.repeatability(events(spark, d).withColumn("device_model", F.when(F.col("device_model").isin("view", "click"), "look").otherwise("act"))))


def temporal_stability(spark: SparkSession, d: str) -> DataFrame:
    return one(m.temporal_stability(events(spark, d)))


def residual_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return one(m.residual_diagnostics(measured(spark, d)))


def residual_strata(spark: SparkSession, d: str) -> DataFrame:
    return one(m.residual_strata(written(m.paired(measured(spark, d)), "pairs")))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return one(m.spearman(predicted(spark, d), "y", "p"))


def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    return one(m.compared(written(m.paired(measured(spark, d)), "pairs")))


def method_comparison_intervals(spark: SparkSession, d: str) -> DataFrame:
    return one(r.method_comparison(measured(spark, d), replicates=REPLICATES))


def _device_mae(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d)
    either = F.array(F.struct(F.lit("scaled").alias("model"), F.col("p")), F.struct(F.lit("shifted").alias("model"), (F.col("p") + 500).alias("p")), F.struct(F.lit("mean").alias("model"), F.lit(38000.0).alias("p")))
    return p.select("y", "grp", F.explode(either).alias("e")).select("y", "grp", "e.model", "e.p")


def device_robustness(spark: SparkSession, d: str) -> DataFrame:
    p = _device_mae(spark, d)
    return one(m.device_robustness(m.regression_metrics(p.where("grp <> 'R'"), "y", "p", ["model"]), m.regression_metrics(p.where("grp = 'R'"), "y", "p", ["model"])))


def interval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return one(m.interval_metrics(predicted(spark, d), "y", "lo", "hi"))


def abstention(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d).withColumn("hi", F.col("hi") + F.col("l_linenumber") * 100)
    return m.abstained(p, "lo", "hi", 40300.0).groupBy("grp").agg(F.count_if("abstain").alias("abstained"), F.count("*").alias("n"))


def row_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    pairs = m.paired(measured(spark, d)).select("subject", "r", "m")
    return one(r.row_bootstrap(pairs, "r", "m", ["subject"], ("mae", "rmse", "r2", "pearson_r"), replicates=REPLICATES))


def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return one(r.cluster_bootstrap(predicted(spark, d), "y", "p", "l_suppkey", replicates=REPLICATES))


def agreement_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return one(r.agreement_bootstrap(m.paired(measured(spark, d)).select("subject", "r", "m"), replicates=REPLICATES))


def slope_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return one(r.slope_bootstrap(m.paired(measured(spark, d)), replicates=REPLICATES))


def permutation_test(spark: SparkSession, d: str) -> DataFrame:
    return one(r.permutation_test(m.paired(measured(spark, d)), "r", "m", "subject", permutations=REPLICATES))


def interval_calibration(spark: SparkSession, d: str) -> DataFrame:
    return one(r.interval_calibration(predicted(spark, d), "y", "lo", "hi", 0.3, "l_suppkey", replicates=REPLICATES))


def split_conformal(spark: SparkSession, d: str) -> DataFrame:
    return one(r.split_conformal(predicted(spark, d), "y", "p"))


def predict_interval(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d)
    model = r.split_conformal(p.where("grp = 'A'"), "y", "p")
    return one(m.interval_metrics(r.predict_interval(p.where("grp <> 'A'"), "p", model), "y", "lower", "upper"))


QUERIES = {
    f.__name__: f
    for f in (
        measurement_agreement, captures_agreement, regression_metrics, bland_altman, coverage_under_uncertainty, grouped_regression, uncertainty_interval, subgroup_metrics, subgroup_robustness, calibration_transfer,
        acquisition_perturbation, repeatability, temporal_stability, residual_diagnostics, residual_strata, spearman, method_comparison, method_comparison_intervals, device_robustness, interval_metrics, abstention,
        row_bootstrap, cluster_bootstrap, agreement_bootstrap, slope_bootstrap, permutation_test, interval_calibration, split_conformal, predict_interval,
    )
}

_MEAS = "meas as (select l_suppkey as patient_id, l_quantity as reference_value, l_quantity * (0.95 + l_discount) - l_tax as measurement_value, 'D' || (l_suppkey % 3) as device_model from lineitem), pr as (select patient_id as subject, avg(reference_value) as r, avg(measurement_value) as m, count(*) as k from meas group by 1)"
_PRED = "pred as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice as y, l_quantity * 1500 as p, l_returnflag as grp, l_quantity * 1500 - 20000 as lo, l_quantity * 1500 + 20000 as hi, 12000.0::double as u from lineitem)"
_EV = "ev as (select user_id as patient_id, event_type as device_model, value as v, ts::date as session_id from events where value is not null and user_id is not null)"


def _metrics(y: str = "y", p: str = "p") -> str:
    e = f"({p} - {y})"
    return f"""count(*) as n, round(avg(abs({e})), 6) as mae, round(sqrt(avg({e} * {e})), 6) as rmse, round(1 - sum({e} * {e}) / nullif(count(*) * var_pop({y}), 0), 6) as r2, round(covar_pop({y}, {p}) / nullif(stddev_pop({y}) * stddev_pop({p}), 0), 6) as pearson_r,
round(avg({e}), 6) as bland_altman_bias, round(avg({e}) - 1.96 * stddev_samp({e}), 6) as bland_altman_lower, round(avg({e}) + 1.96 * stddev_samp({e}), 6) as bland_altman_upper, round(avg(({y} + {p}) / 2), 6) as mean_reference"""


def _agreement(pairs: str) -> str:
    return f"""select sum(k)::bigint as n_rows, count(*) as n_pairs, round(avg(r), 6) as mean_reference, round(avg(m), 6) as mean_measurement, round(avg(m - r), 6) as mean_bias, round(100 * avg(m - r) / abs(avg(r)), 6) as relative_bias_percent,
round(avg(abs(m - r)), 6) as mae, round(sqrt(avg((m - r) * (m - r))), 6) as rmse, round(stddev_samp(m - r), 6) as error_sd, round(avg(m - r) - 1.96 * stddev_samp(m - r), 6) as loa_low, round(avg(m - r) + 1.96 * stddev_samp(m - r), 6) as loa_high,
round(coalesce(100 * avg(m - r) * avg(m - r) / nullif(avg(m - r) * avg(m - r) + coalesce(var_samp(m - r), 0), 0), 0), 6) as systematic_error_fraction_percent from {pairs}"""


def _subgroups(pairs: str) -> str:
    return f"""with {_MEAS}, g as ({pairs}) select device_model as subgroup, count(*) as n_pairs, round(avg(r), 6) as mean_reference, round(avg(m), 6) as mean_measurement, round(avg(m - r), 6) as mean_bias, round(avg(abs(m - r)), 6) as mae, round(sqrt(avg((m - r) * (m - r))), 6) as rmse,
round(100 * avg(m - r) / avg(r), 6) as relative_bias_percent, (select round(avg(abs(m - r)), 6) from g) as overall_mae, (select round(sqrt(avg((m - r) * (m - r))), 6) from g) as overall_rmse from g group by device_model"""


def _ranks(source: str, columns: str, *ranked: str) -> str:
    return f"select {columns}, " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as rank_{c}" for c in ranked) + f" from {source}"


def _corr(a: str, b: str) -> str:
    return f"round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6)"


_DRAW = f"(('0x' || substr(md5('42-' || rep || '-' || pos), 1, 8))::bigint %"
_SUMS = "count(*) as n, sum(y) as sy, sum(p) as sp, sum(y * y) as syy, sum(p * p) as spp, sum(y * p) as syp, sum(abs(p - y)) as sa, sum((p - y) * (p - y)) as se, sum(p - y) as s1"
_NAMES = ("n", "sy", "sp", "syy", "spp", "syp", "sa", "se", "s1")
_OF = {
    "mae": "sa / n", "rmse": "sqrt(se / n)", "r2": "1 - se / (syy - sy * sy / n)", "pearson_r": "(syp - sy * sp / n) / sqrt((syy - sy * sy / n) * (spp - sp * sp / n))", "bias": "s1 / n",
    "loa_low": "s1 / n - 1.96 * sqrt(greatest((se - s1 * s1 / n) / (n - 1), 0))", "loa_high": "s1 / n + 1.96 * sqrt(greatest((se - s1 * s1 / n) / (n - 1), 0))",
}


def _boot(ctes: str, units: str, key: str, *metrics: str) -> str:
    head = f"""with {ctes}, units as ({units}), placed as materialized (select *, row_number() over (order by {key}) - 1 as idx from units), n_units as (select count(*) as c from placed),
d as (select rep, {_DRAW} c) as idx from range({REPLICATES}) t(rep), n_units, lateral (select unnest(range(c)) as pos)), reps as (select rep, {", ".join(f"sum({c}) as {c}" for c in _NAMES)} from d join placed using (idx) group by rep), total as (select {", ".join(f"sum({c}) as {c}" for c in _NAMES)} from placed)"""
    return head + " union all ".join(
        f" select '{m}' as metric, (select round({_OF[m]}, 6) from total) as estimate, round(quantile_cont({_OF[m]}, 0.025), 6) as lower, round(quantile_cont({_OF[m]}, 0.975), 6) as upper, (select c from n_units) as n_units, {REPLICATES} as n_bootstrap, 0.95::double as confidence from reps" for m in metrics
    )


_PAIR_UNITS = f"select subject, {_SUMS} from (select subject, r as y, m as p from pr) group by subject"

_POINTS = f"""with {_MEAS}, v as (select var_samp(r) as sxx, var_samp(m) as syy, covar_samp(r, m) as sxy, avg(r) as mr, avg(m) as mm, sum(k)::bigint as n_rows, count(*) as n_pairs from pr), dm as (select *, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) as slope from v),
pb as (select median((b.m - a.m) / (b.r - a.r)) as slope from pr a join pr b on a.subject < b.subject and a.r <> b.r)
select n_rows, n_pairs, round(mr, 6) as mean_reference, round(mm, 6) as mean_measurement, round(dm.slope, 6) as deming_slope, round(mm - dm.slope * mr, 6) as deming_intercept, round(pb.slope, 6) as passing_bablok_slope, (select round(median(m - pb.slope * r), 6) from pr) as passing_bablok_intercept, 1.0::double as variance_ratio from dm, pb"""

SQL = {
    "measurement_agreement": f"with {_MEAS} {_agreement('pr')}",
    "captures_agreement": f"""with c as (select patient_id, target_value as rv, target_value * (1 + coalesce(incidence_angle_deg, 0) / 1000) - coalesce(working_distance_mm, 0) / 2000 as mv from captures where target_value is not null and not isnan(target_value) and patient_id is not null and device_model is not null),
pr as (select patient_id, avg(rv) as r, avg(mv) as m, count(*) as k from c group by 1) {_agreement('pr')}""",
    "regression_metrics": f"with {_PRED} select {_metrics()}, 'scaled' as model from pred",
    "bland_altman": f"with {_PRED} select count(*) as n, round(avg(p - y), 6) as bias, round(avg(p - y) - 1.96 * stddev_samp(p - y), 6) as loa_low, round(avg(p - y) + 1.96 * stddev_samp(p - y), 6) as loa_high from pred",
    "coverage_under_uncertainty": f"with {_PRED} select round(avg((abs(y - p) <= 1.96 * u)::int), 6) as coverage from pred",
    "grouped_regression": f'with {_PRED} select grp as "group", count(*) as n, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg((p - y) * (p - y))), 6) as rmse, round(avg(p - y), 6) as bias from pred group by grp',
    "uncertainty_interval": f"with {_PRED} select grp, round(avg(p - 1.96 * u), 6) as lower, round(avg(p + 1.96 * u), 6) as upper from pred group by grp",
    "subgroup_metrics": f'with {_PRED} select grp as "group", {_metrics()} from pred group by grp having count(*) >= 10',
    "subgroup_robustness": _subgroups("select patient_id, device_model, avg(reference_value) as r, avg(measurement_value) as m from meas group by all"),
    "calibration_transfer": _subgroups("select patient_id, device_model, avg(reference_value) as r, avg(1.02 * measurement_value + 0.1) as m from meas group by all"),
    "acquisition_perturbation": f"""with {_EV}, s as (select patient_id, device_model as condition, avg(v) as v from ev group by all)
select a.condition, count(*) as n_pairs, round(avg(a.v - b.v), 6) as mean_bias, round(stddev_samp(a.v - b.v), 6) as sd_bias, round(100 * avg(a.v - b.v) / nullif(abs(avg(b.v)), 0), 6) as relative_bias_percent, round(avg(a.v - b.v) - 1.96 * stddev_samp(a.v - b.v), 6) as loa_low, round(avg(a.v - b.v) + 1.96 * stddev_samp(a.v - b.v), 6) as loa_high
from s a join s b on a.patient_id = b.patient_id and b.condition = 'view' where a.condition <> 'view' group by 1""",
    "repeatability": f"""with {_EV}, e as (select patient_id, v, case when device_model in ('view', 'click') then 'look' else 'act' end as device_model from ev), s as (select patient_id, count(*) as n, avg(v) as mean, stddev_samp(v) as sd from e group by 1),
b as (select patient_id, avg(v) filter (device_model = 'act') as a, avg(v) filter (device_model = 'look') as b from e group by 1 having a is not null and b is not null)
select sum(n)::bigint as n_rows, count(*) as n_subjects, count(*) filter (n >= 2) as n_repeated_subjects, round(sqrt(avg(sd * sd) filter (n >= 2)), 6) as within_subject_sd, round(2.77 * sqrt(avg(sd * sd) filter (n >= 2)), 6) as repeatability_coefficient,
round(avg(100 * sd / abs(mean)) filter (n >= 2 and mean <> 0), 6) as mean_within_subject_cv_percent, (select count(distinct device_model) from e) as n_devices, (select round(avg(b - a), 6) from b) as between_device_mean_bias, (select round(stddev_samp(b - a), 6) from b) as between_device_sd,
(select round(avg(b - a) - 1.96 * stddev_samp(b - a), 6) from b) as between_device_loa_low, (select round(avg(b - a) + 1.96 * stddev_samp(b - a), 6) from b) as between_device_loa_high from s""",
    "temporal_stability": f"""with {_EV}, s as (select session_id, avg(v) as mean, count(*) as n from ev group by 1), t as (select *, row_number() over (order by session_id) - 1 as x, first(mean) over (order by session_id) as base from s)
select sum(n)::bigint as n_rows, count(*) as n_sessions, round(first(base), 6) as baseline_mean, round(100 * stddev_samp(mean) / abs(avg(mean)), 6) as session_mean_cv_percent, round(max(abs(100 * (mean - base) / abs(base))), 6) as max_abs_relative_drift_percent, round(regr_slope(mean, x), 6) as linear_drift_per_session from t""",
    "residual_diagnostics": f"""with {_MEAS}, q as (select *, m - r as res, abs(m - r) as abs_ from pr), k as ({_ranks('q', 'k, r, m, res, abs_', 'r', 'm', 'res', 'abs_')})
select sum(k)::bigint as n_rows, count(*) as n_pairs, round(avg(r), 6) as mean_reference, round(avg(m), 6) as mean_measurement, round(avg(res), 6) as mean_residual, round(stddev_samp(res), 6) as residual_sd, round(avg(abs_), 6) as mae, round(sqrt(avg(res * res)), 6) as rmse, round(100 * avg(abs_ / abs(r)), 6) as mean_absolute_relative_error_percent,
{_corr('rank_r', 'rank_res')} as spearman_reference_residual, {_corr('rank_r', 'rank_abs_')} as spearman_reference_absolute_residual, {_corr('rank_r', 'rank_m')} as spearman_reference_measurement, round(regr_slope(abs_, r), 6) as absolute_residual_slope from k""",
    "residual_strata": f"""with {_MEAS}, e as (select unnest(list_distinct(quantile_cont(r, [0.25, 0.5, 0.75]))) as x, min(r) as lo, max(r) as hi from pr), i as (select x from e where x > lo and x < hi), s as (select r, m - r as res, (select count(*) from i where x < r)::int as stratum from pr)
select stratum, count(*) as n, round(avg(r), 6) as reference_mean, round(avg(res), 6) as residual_mean, round(stddev_samp(res), 6) as residual_sd, round(avg(abs(res)), 6) as mae from s group by stratum""",
    "spearman": f"with {_PRED}, k as ({_ranks('pred', 'y', 'y', 'p')}) select {_corr('rank_y', 'rank_p')} as spearman from k",
    "device_robustness": f"""with {_PRED}, e as (select y, grp, 'scaled' as model, p from pred union all select y, grp, 'shifted', p + 500 from pred union all select y, grp, 'mean', 38000 from pred), g as (select model, grp = 'R' as held, avg(abs(p - y)) as mae, sqrt(avg((p - y) * (p - y))) as rmse from e group by all)
select a.model, round(a.mae, 6) as mae_source, round(b.mae, 6) as mae_held_out, round(a.rmse, 6) as rmse_source, round(b.rmse, 6) as rmse_held_out, round((b.mae - a.mae) / a.mae, 6) as mae_relative_change, round((b.rmse - a.rmse) / a.rmse, 6) as rmse_relative_change from g a join g b on a.model = b.model and not a.held and b.held""",
    "interval_metrics": f"with {_PRED} select count(*) as n, round(avg((y between lo and hi)::int), 6) as coverage, round(avg(hi - lo), 6) as mean_width, round(median(hi - lo), 6) as median_width from pred",
    "abstention": f"with {_PRED} select grp, count(*) filter (hi + l_linenumber * 100 - lo > 40300) as abstained, count(*) as n from pred group by grp",
    "row_bootstrap": _boot(_MEAS, _PAIR_UNITS, "subject", "mae", "rmse", "r2", "pearson_r"),
    "cluster_bootstrap": _boot(_PRED, f"select l_suppkey, {_SUMS} from pred group by l_suppkey", "l_suppkey", "mae", "rmse", "r2", "pearson_r"),
    "agreement_bootstrap": _boot(_MEAS, _PAIR_UNITS, "subject", "bias", "mae", "rmse", "loa_low", "loa_high"),
    "permutation_test": f"""with {_MEAS}, placed as materialized (select r as y, m as p, row_number() over (order by subject) - 1 as idx from pr), o as (select avg(abs(p - y)) as observed, count(*) as n from placed),
s as (select rep, p, row_number() over (partition by rep order by md5('42-' || rep || '-' || idx), idx) - 1 as idx from placed, range({REPLICATES}) t(rep)), v as (select rep, avg(abs(s.p - placed.y)) as v from s join placed using (idx) group by rep)
select 'mae' as metric, round(observed, 6) as observed, round(avg(v), 6) as null_mean, round(stddev_samp(v), 6) as null_std, round((1 + count(*) filter (v <= observed)) / {REPLICATES + 1}.0, 6) as p_value, {REPLICATES} as n_permutations, n from v, o group by observed, n""",
    "slope_bootstrap": f"""with {_MEAS}, placed as materialized (select r, m, row_number() over (order by subject) - 1 as idx from pr), n_units as (select count(*) as c from placed),
d as materialized (select rep, pos, r, m from (select rep, pos, {_DRAW} c) as idx from range({REPLICATES}) t(rep), n_units, lateral (select unnest(range(c)) as pos)) join placed using (idx)),
v as (select rep, var_samp(r) as sxx, var_samp(m) as syy, covar_samp(r, m) as sxy, avg(r) as mr, avg(m) as mm from d group by rep), pb as (select a.rep, median((b.m - a.m) / (b.r - a.r)) as slope from d a join d b on a.rep = b.rep and a.pos < b.pos and a.r <> b.r group by a.rep),
s as (select rep, mr, mm, pb.slope, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) as deming from v join pb using (rep) where sxx <> 0 and sxy <> 0), i as (select rep, median(m - slope * r) as intercept from s join d using (rep) group by rep),
x as (select unnest(['deming_slope', 'deming_intercept', 'passing_bablok_slope', 'passing_bablok_intercept']) as metric, unnest([deming, mm - deming * mr, slope, intercept]) as v from s join i using (rep))
select metric, round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper, count(v) as n_defined from x group by metric""",
    "interval_calibration": f"""with {_PRED}, units as (select l_suppkey, count(*) as n, sum((y between lo and hi)::int) as hit from pred group by 1), placed as materialized (select *, row_number() over (order by l_suppkey) - 1 as idx from units), n_units as (select count(*) as c from placed),
d as (select rep, {_DRAW} c) as idx from range({REPLICATES}) t(rep), n_units, lateral (select unnest(range(c)) as pos)), reps as (select rep, sum(hit) / sum(n) as v from d join placed using (idx) group by rep)
select sum(n)::bigint as n_rows, count(*) as n_subjects, round(sum(hit) / sum(n), 6) as observed_coverage, (select round(quantile_cont(v, 0.025), 6) from reps) as coverage_ci_low, (select round(quantile_cont(v, 0.975), 6) from reps) as coverage_ci_high, (select round(avg(hi - lo), 6) from pred) as mean_width, (select round(median(hi - lo), 6) from pred) as median_width,
0.7::double as nominal_coverage, round(sum(hit) / sum(n) - 0.7, 6) as coverage_error, round(1 - sum(hit) / sum(n), 6) as miss_rate from placed""",
    "split_conformal": f"""with {_PRED}, s as (select abs(p - y) as score, row_number() over (order by abs(p - y)) as k, count(*) over () as n from pred) select (select round(score, 6) from s where k = least(n, greatest(1, ceil((n + 1) * 0.9)))) as quantile, 0.1::double as alpha, count(*) as n, round(sqrt(avg(score * score)), 6) as calibration_rmse from s""",
    "predict_interval": f"""with {_PRED}, s as (select abs(p - y) as score, row_number() over (order by abs(p - y)) as k, count(*) over () as n from pred where grp = 'A'), q as (select score as q from s where k = least(n, greatest(1, ceil((n + 1) * 0.9))))
select count(*) as n, round(avg((y between p - q and p + q)::int), 6) as coverage, round(avg((p + q) - (p - q)), 6) as mean_width, round(median((p + q) - (p - q)), 6) as median_width from pred, q where grp <> 'A'""",
}

SQL["method_comparison"] = _POINTS
SQL["method_comparison_intervals"] = f"""select * from ({_POINTS}), (select {', '.join(f"max({end}) filter (metric = '{c}') as {c}_ci_{name}" for c in r.SLOPES for end, name in (('lower', 'low'), ('upper', 'high')))} from ({SQL['slope_bootstrap']}))"""
