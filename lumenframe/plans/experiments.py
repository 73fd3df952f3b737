"""Reports that put gates, models, intervals and statistics together. A failed gate ends a report before any statistic."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import beside, rounded
from ..operators import gates, measurement, models, relations, resampling
from ..sources.sinks import report_dict
from ..sources.tables import table
from . import equations

IDENTITY = ("patient_id", "acquisition_id", "image_id")
#: What identifies an experiment (fixed values).
MANIFEST = ("dataset", "dataset_version", "split_protocol", "feature_set", "model", "calibration_id", "uncertainty_id")


def manifest_hash(*, random_seed: int, **given: str) -> str:
    """SHA-256 of the canonical JSON of an experiment's identifiers and seed; missing, unknown or blank ones and negative seeds fail."""
    if set(given) != set(MANIFEST) or any(v is None or not str(v).strip() for v in given.values()):
        raise ValueError(f"each of {', '.join(MANIFEST)} must be given and not blank")
    if isinstance(random_seed, bool) or int(random_seed) != random_seed or random_seed < 0:
        raise ValueError("the seed must be a whole number that isn't negative")
    return hashlib.sha256(json.dumps(given | {"random_seed": int(random_seed)}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def content_version(df: DataFrame) -> str:
    """Rows and an order-free hash of their content, which names a version of a table."""
    columns = [F.to_json(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in sorted(df.dtypes)]
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("x"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{(r['x'] or 0) & (1 << 64) - 1:016x}-{r['s'] or 0}"


def frozen_external(df: DataFrame, y: str, p: str, model: str, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """One row: error metrics of predictions made elsewhere and, with both bounds, the coverage and width of their intervals. Nothing is fitted."""
    if (lower is None) != (upper is None):
        raise ValueError("both bounds are required, or neither")
    out = measurement.regression_metrics(df, y, p, model=model)
    return out if lower is None else beside(out, measurement.interval_metrics(df, y, lower, upper).drop("n"))


@dataclass(frozen=True)
class ExperimentConfig:
    features: tuple[str, ...]
    biomarker: str = "hemoglobin"
    target_unit: str = "g/dL"
    model: str = "ridge"
    alpha: float = 0.10
    max_interval_width: float | None = None
    n_bootstrap: int = 2000
    n_permutations: int = 2000
    seed: int = 42

    def __post_init__(self) -> None:
        if not self.features or not 0 < self.alpha < 1 or self.n_bootstrap < 100 or self.n_permutations < 1 or (self.max_interval_width is not None and self.max_interval_width <= 0):
            raise ValueError("the experiment's configuration is invalid")


def benchmark(df: DataFrame, y: str, p: str, patient: str = "patient_id", row_id: str = "image_id", n_bootstrap: int = 2000, n_permutations: int = 2000, seed: int = 42, manifest: str | None = None) -> DataFrame:
    """(metric, estimate, lower, upper, p_value): error metrics with patient bootstrap intervals, one set of draws for all, and permutation tests of mae and rmse; with the experiment's hash, if given, on each."""
    ci = resampling.cluster_bootstrap(df, y, p, patient, replicates=n_bootstrap, seed=seed)
    tests = resampling.permutation_tests(df, y, p, row_id, ("mae", "rmse"), n_permutations, seed).select("metric", "p_value")
    out = ci.join(tests, "metric", "left").select("metric", "estimate", "lower", "upper", "p_value", "n_units", "n_bootstrap")
    return out if manifest is None else out.withColumn("manifest_hash", F.lit(manifest))


def gate_report(partitions: DataFrame, partition: str, biomarker: str, unit: str) -> DataFrame:
    """(check, n) of everything that keeps a set of partitions from being measured: rules by name, and identifiers in two partitions."""
    rules = [*gates.target_rules(biomarker, unit), *gates.roi_rules(True), *gates.acquisition_rules(), *gates.partition_identity(partitions)]
    broken = gates.verdict(partitions, [r for r in rules if r.level == "error"]).select(F.col("rule").alias("check"), "n")
    shared = relations.overlap_counts(partitions, partition, IDENTITY)
    return broken.union(shared.select(F.concat_ws("__", F.lit("overlap"), "kind", "a", "b").alias("check"), "n"))


def quantitative_report(evaluation: DataFrame, others: DataFrame, config: ExperimentConfig, prediction: str = "prediction", manifest: str | None = None) -> dict:
    """passed, errors and, only if there are none, the error metrics and the benchmark of keyed predictions."""
    everything = evaluation.withColumn("_part", F.lit("evaluation")).unionByName(others, allowMissingColumns=True)
    errors = [f"{r['check']}: {r['n']}" for r in gate_report(everything, "_part", config.biomarker, config.target_unit).where("n > 0").orderBy("check").collect()]
    if errors:
        return {"passed": False, "errors": errors, "metrics": None, "benchmark": None}
    rows = benchmark(evaluation, "target_value", prediction, n_bootstrap=config.n_bootstrap, n_permutations=config.n_permutations, seed=config.seed, manifest=manifest).collect()
    metrics = report_dict(measurement.regression_metrics(evaluation, "target_value", prediction))
    return {"passed": True, "errors": [], "metrics": metrics, "benchmark": {r["metric"]: r.asDict() for r in rows}}


def scientific_experiment(train: DataFrame, calibration: DataFrame, test: DataFrame, config: ExperimentConfig) -> dict:
    """Validate, fit on train, take intervals from calibration, and report on test."""
    for part in (train, calibration, test):
        relations.require_features(part, config.features, "target_value", config.biomarker, config.target_unit)
    named = [p.withColumn("_part", F.lit(n)) for n, p in (("train", train), ("calibration", calibration), ("test", test))]
    all_parts = named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)
    if not relations.partition_overlaps(all_parts, "_part", IDENTITY).isEmpty():
        raise ValueError("patients, acquisitions or images overlap between partitions")
    predict = models.fitted(config.model, train, config.features, "target_value")
    conformal = resampling.split_conformal(predict(calibration), "target_value", "prediction", config.alpha)
    predicted = resampling.predict_interval(predict(test), "prediction", conformal)
    intervals = report_dict(measurement.interval_metrics(predicted, "target_value", "lower", "upper"))
    hashed = manifest_hash(dataset=f"{config.biomarker} in {config.target_unit}", dataset_version=content_version(all_parts), split_protocol="given train, calibration and test", feature_set=",".join(config.features), model=config.model, calibration_id=f"split conformal {config.alpha!r}", uncertainty_id=f"interval width {config.max_interval_width!r}", random_seed=config.seed)
    report = quantitative_report(predicted, named[0].unionByName(named[1], allowMissingColumns=True), config, manifest=hashed)
    width = config.max_interval_width
    abstained = 0 if width is None else measurement.abstained(predicted, "lower", "upper", width).where("abstain").count()
    counts = {r["_part"]: r["n"] for r in all_parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    return report | {"manifest_hash": hashed, "n": counts, "model": config.model, "uncertainty": intervals | report_dict(conformal), "abstained": abstained}


# Queries over the given tables.


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Complete captures of the four splits with a few numeric features."""
    c = table(spark, d, "captures").where("target_value is not null and not isnan(target_value) and patient_id is not null")
    return c.selectExpr("record_id", "patient_id", "split_name", "target_value", "coalesce(exposure_us, 0) / 10000 as f1", "coalesce(iso, 0) / 100 as f2", "coalesce(working_distance_mm, 0) / 100 + target_value / 20 as f3", "cast(biomarker = 'bilirubin' as int) as f4")


FEATURES = ("f1", "f2", "f3", "f4")


def linear_baselines(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    return rounded(models.fit_and_evaluate(f.where("split_name = 'train'"), f.where("split_name = 'test'"), FEATURES, "target_value"))


def tree_baselines(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    return rounded(models.fit_and_evaluate(f.where("split_name = 'train'"), f.where("split_name = 'test'"), FEATURES, "target_value", ("random_forest", "gradient_boosting")))


def nested_selection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.nested_group_cv(_features(spark, d), FEATURES, "target_value", "patient_id"))


def affine_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Colours mapped to a reference: line items' columns stand for both."""
    li = table(spark, d, "lineitem").selectExpr("l_returnflag", "l_quantity / 50 as r", "l_discount * 10 as g", "l_tax * 10 as b")
    seen = li.selectExpr("*", "0.9 * r + 0.05 * g + 0.02 as ref_r", "0.1 * r + 0.8 * g as ref_g", "0.05 * r * r + 0.9 * b + 0.01 as ref_b")
    ref = ("ref_r", "ref_g", "ref_b")
    maps = models.fit_affine(seen.where("l_returnflag <> 'R'"), ("r", "g", "b"), ref, "train")
    out = models.apply_affine(seen.where("l_returnflag = 'R'"), maps, ("cal_r", "cal_g", "cal_b"))
    return rounded(out.agg(*(F.sqrt(F.avg((F.col(f"cal_{c}") - F.col(f"ref_{c}")) * (F.col(f"cal_{c}") - F.col(f"ref_{c}")))).alias(f"rmse_{c}") for c in "rgb"), F.lit(models.affine_rmse(seen.where("l_returnflag <> 'R'"), maps, ref)).alias("fit_rmse")), 5)


def conformal_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Ridge on train, conformal interval from calibration, coverage on test."""
    f = _features(spark, d)
    model = models.fit_linear(f.where("split_name = 'train'"), FEATURES, "target_value", 1.0)
    conformal = resampling.split_conformal(model.predict(f.where("split_name = 'calibration'")), "target_value", "prediction")
    predicted = resampling.predict_interval(model.predict(f.where("split_name = 'test'")), "prediction", conformal)
    return rounded(measurement.interval_metrics(predicted, "target_value", "lower", "upper"))


def external_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Frozen readings of captures of one source, with bounds."""
    f = _features(spark, d).withColumn("prediction", F.expr("20 * f3 - 20")).withColumns({"lower": F.expr("prediction - 5"), "upper": F.expr("prediction + 5")})
    return rounded(frozen_external(f.where("split_name = 'validation'"), "target_value", "prediction", "linear reading", "lower", "upper"))


def gate_checks(spark: SparkSession, d: str) -> DataFrame:
    return gate_report(table(spark, d, "captures"), "split_name", "hemoglobin", "g/dL")


def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a fixed linear reading of captures, with intervals over patients."""
    f = _features(spark, d).where("split_name = 'test'").withColumn("prediction", F.expr("20 * f3 - 20")).withColumn("image_id", F.col("record_id"))
    return rounded(benchmark(f, "target_value", "prediction"))


QUERIES = {f.__name__: f for f in (linear_baselines, tree_baselines, nested_selection, affine_calibration, conformal_experiment, external_evaluation, gate_checks, benchmark_report)}


def _gate_sql() -> str:
    from . import tabular as t

    mismatch = {"biomarker_mismatch": (f"{t._TFIELDS} and {t._low('biomarker')} <> 'hemoglobin'", "error"), "unit_mismatch": (f"{t._TFIELDS} and regexp_replace(target_unit, '^\\s+|\\s+$', '', 'g') <> 'g/dL'", "error")}
    regions = {k: v for k, v in t._CANON.items() if k.startswith("roi_")}
    sets = ({**t._TARGET, **mismatch}, regions, {k: v for k, v in t._ACQ.items() if v[1] == "error"}, t._IDENT)
    counts = " union all ".join(f"select '{name}' as \"check\", count(*) filter ({cond}) as n from captures" for rules in sets for name, (cond, _) in rules.items())
    overlaps = t.SQL["overlap_counts"]
    return f"{counts} union all select concat_ws('__', 'overlap', kind, a, b), n from ({overlaps})"


_F = """f as materialized (select record_id, patient_id, split_name, target_value as t, coalesce(exposure_us, 0) / 10000 as f1, coalesce(iso, 0) / 100 as f2, coalesce(working_distance_mm, 0) / 100 + target_value / 20 as f3, (biomarker = 'bilirubin')::int as f4
from captures where target_value is not null and not isnan(target_value) and patient_id is not null)"""


def _baselines_sql() -> str:
    from .statistics import _metrics

    parts = []
    for model, fit in (("linear", equations.ridge("linear", "g", 4, "0")), ("ridge", equations.ridge("ridge", "g", 4, "1")), ("lasso", equations.lasso("lasso", "g", 4, 0.01))):
        parts.append((fit, f"select {_metrics('t', 'p')}, '{model}' as model from (select t, {equations.reading(FEATURES)} as p from f, {model} where split_name = 'test')"))
    return f"with recursive {_F}, {equations.gram('g', 'f', FEATURES, ['t'], where=_TRAIN)}, {', '.join(p[0] for p in parts)} {' union all '.join(p[1] for p in parts)}"


_TRAIN = "split_name = 'train'"


def _affine_sql() -> str:
    rgb, ref = ("r", "g", "b"), ("ref_r", "ref_g", "ref_b")
    seen = """li as (select l_returnflag, l_quantity / 50 as r, l_discount * 10 as g, l_tax * 10 as b from lineitem), seen as materialized (select *, 0.9 * r + 0.05 * g + 0.02 as ref_r, 0.1 * r + 0.8 * g as ref_g, 0.05 * r * r + 0.9 * b + 0.01 as ref_b from li)"""
    off = lambda t: f"avg(({equations.reading(rgb, 'm.')} - {t}) * ({equations.reading(rgb, 'm.')} - {t}))"
    held = ", ".join(f"(select round(sqrt({off(t)}), 5) from seen, fit m where m.target = '{t}' and l_returnflag = 'R') as rmse_{t[-1]}" for t in ref)
    fitted = " + ".join(f"(select {off(t)} from seen, fit m where m.target = '{t}' and l_returnflag <> 'R')" for t in ref)
    return f"with {seen}, {equations.gram('q', 'seen', rgb, ref, where=_KEPT)}, {equations.ridge('fit', 'q', 3, '0')} select {held}, round(sqrt(({fitted}) / 3), 5) as fit_rmse"


_KEPT = "l_returnflag <> 'R'"


def _conformal_sql() -> str:
    return f"""with {_F}, {equations.gram('g', 'f', FEATURES, ['t'], where=_TRAIN)}, {equations.ridge('ridge', 'g', 4, '1')}, p as materialized (select split_name, t, {equations.reading(FEATURES)} as p from f, ridge),
s as (select abs(p - t) as score, row_number() over (order by abs(p - t)) as k, count(*) over () as n from p where split_name = 'calibration'), q as (select score as q from s where k = least(n, greatest(1, ceil((n + 1) * 0.9))))
select count(*) as n, round(avg((t between p - q and p + q)::int), 6) as coverage, round(avg((p + q) - (p - q)), 6) as mean_width, round(median((p + q) - (p - q)), 6) as median_width from p, q where split_name = 'test'"""


def _benchmark_sql() -> str:
    from .statistics import _SUMS, REPLICATES, _boot

    b = f"{_F}, b as materialized (select record_id, patient_id, t as y, 20 * f3 - 20 as p from f where split_name = 'test')"
    boot = _boot(b, f"select patient_id, {_SUMS} from b group by patient_id", "patient_id", "mae", "rmse", "r2", "pearson_r")
    tests = f"""with {b}, placed as materialized (select y, p, row_number() over (order by record_id) - 1 as idx from b), o as (select avg(abs(p - y)) as mae, sqrt(avg((p - y) * (p - y))) as rmse from placed),
s as (select rep, p, row_number() over (partition by rep order by md5('42-' || rep || '-' || idx), idx) - 1 as idx from placed, range({REPLICATES}) t(rep)), v as (select rep, avg(abs(s.p - placed.y)) as mae, sqrt(avg((s.p - placed.y) * (s.p - placed.y))) as rmse from s join placed using (idx) group by rep),
w as (select count(*) filter (v.mae <= o.mae) as mae, count(*) filter (v.rmse <= o.rmse) as rmse from v, o) select 'mae' as metric, round((1 + mae) / {REPLICATES + 1}.0, 6) as p_value from w union all select 'rmse', round((1 + rmse) / {REPLICATES + 1}.0, 6) from w"""
    return f"select metric, estimate, lower, upper, p_value, n_units, n_bootstrap from ({boot}) left join ({tests}) using (metric)"


def _nested_sql(outer: int = 5, inner: int = 4) -> str:
    fold = lambda n: f"(case when (k // {n}) % 2 = 0 then k % {n} else {n - 1} - k % {n} end)::int"
    return f"""with {_F}, sizes as (select patient_id, count(*) as size from f group by 1), outer_ as materialized (select patient_id, size, {fold(outer)} as held from (select *, row_number() over (order by size desc, patient_id) - 1 as k from sizes)),
inner_ as materialized (select patient_id, o, {fold(inner)} as part from (select patient_id, o, row_number() over (partition by o order by size desc, patient_id) - 1 as k from outer_, range({outer}) t(o) where held <> o)),
train as materialized (select o, part, f.* from inner_ join f using (patient_id)), shown as (select i, train.* from train, range({inner}) t(i) where part <> i),
{equations.gram('g', 'shown', FEATURES, ['t'], by=('o', 'i'))}, ga as (select * from g, (values (0.1::double), (1.0), (10.0)) v(alpha)), {equations.ridge('fit', 'ga', 4, 'alpha')},
loss as (select o, i, alpha, avg(abs({equations.reading(FEATURES, 'm.')} - t)) as mae from train join fit m using (o) where train.part = m.i group by all), best as (select o, arg_min(alpha, (loss, alpha)) as alpha from (select o, alpha, sum(mae) as loss from loss group by all) group by o),
{equations.gram('h', 'train', FEATURES, ['t'], by=('o',))}, hb as (select * from h join best using (o)), {equations.ridge('last', 'hb', 4, 'alpha')},
e as (select o, alpha, {equations.reading(FEATURES, 'm.')} - t as e from outer_ join f using (patient_id) join last m on m.o = held)
select o::int as fold, alpha, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse from e group by all"""


def _external_sql() -> str:
    from .statistics import _metrics

    return f"with {_F}, e as (select t, 20 * f3 - 20 as p from f where split_name = 'validation') select {_metrics('t', 'p')}, 'linear reading' as model, round(avg((t between p - 5 and p + 5)::int), 6) as coverage, round(avg((p + 5) - (p - 5)), 6) as mean_width, round(median((p + 5) - (p - 5)), 6) as median_width from e"


SQL = {"gate_checks": _gate_sql(), "external_evaluation": _external_sql(), "nested_selection": _nested_sql(), "linear_baselines": _baselines_sql(), "affine_calibration": _affine_sql(), "conformal_experiment": _conformal_sql(), "benchmark_report": _benchmark_sql()}
