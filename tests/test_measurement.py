import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.ordering import indexed, order_statistics, quantiles
from lumenframe.operators import measurement as m
from lumenframe.operators import resampling
from tests.conftest import one, rows


def frame(spark, data, names="patient_id string, reference_value double, measurement_value double"):
    return spark.createDataFrame(data, names)


def test_agreement(spark):
    r = one(m.measurement_agreement(frame(spark, [("1", 10.0, 11.0), ("2", 20.0, 19.0), ("3", 30.0, 31.0)])))
    assert r["mean_bias"] == pytest.approx(1 / 3) and r["mae"] == pytest.approx(1) and r["rmse"] == pytest.approx(1)
    assert r["error_sd"] == pytest.approx(math.sqrt(4 / 3)) and r["loa_low"] == pytest.approx(1 / 3 - 1.96 * math.sqrt(4 / 3))


def test_repeats_are_averaged_first(spark):
    r = one(m.measurement_agreement(frame(spark, [("1", 10.0, 11.0), ("1", 12.0, 13.0), ("2", 20.0, 19.0), ("2", 20.0, 21.0)])))
    assert (r["n_pairs"], r["n_rows"], r["mean_reference"], r["mean_measurement"], r["mean_bias"]) == (2, 4, 15.5, 16.0, 0.5)


def test_one_pair_has_no_spread(spark):
    r = one(m.measurement_agreement(frame(spark, [("1", 10.0, 11.0)])))
    assert r["error_sd"] is None and r["loa_low"] is None and r["systematic_error_fraction_percent"] == 100


@pytest.mark.parametrize("bad", [("2", float("nan"), 1.0), ("2", 1.0, float("inf")), ("2", None, 1.0), (None, 1.0, 1.0)])
def test_agreement_fails_closed(spark, bad):
    with pytest.raises(Exception, match="finite|identifiers"):
        m.measurement_agreement(frame(spark, [("1", 10.0, 11.0), bad])).collect()


def test_empty_fails(spark):
    with pytest.raises(Exception, match="at least 1"):
        m.measurement_agreement(frame(spark, [])).collect()


def test_subgroups(spark):
    df = frame(spark, [(f"{d}{i}", r, r + (d == "B"), d) for d in "AB" for i, r in enumerate((10.0, 12.0, 14.0))], "patient_id string, reference_value double, measurement_value double, device_model string")
    got = {r["subgroup"]: r for r in m.subgroup_robustness(df).collect()}
    assert got["A"]["overall_mae"] == 0.5 and got["A"]["mean_bias"] == 0 and got["B"]["mean_bias"] == 1
    with pytest.raises(Exception, match="one subgroup"):
        m.subgroup_robustness(df.withColumn("patient_id", F.lit("x"))).collect()


def test_perturbation(spark):
    df = spark.createDataFrame([(str(i), c, v) for i, (a, b) in enumerate([(10.0, 11.0), (20.0, 22.0), (30.0, 33.0)]) for c, v in (("ref", a), ("shift", b))], "patient_id string, perturbation string, measurement_value double")
    r = one(m.acquisition_perturbation(df, "ref"))
    assert (r["n_pairs"], r["mean_bias"], r["sd_bias"]) == (3, 2, 1) and r["relative_bias_percent"] == pytest.approx(10) and r["loa_low"] == pytest.approx(0.04) and r["loa_high"] == pytest.approx(3.96)


def test_repeatability(spark):
    df = spark.createDataFrame([("1", "A", 10.0), ("1", "A", 11.0), ("2", "A", 20.0), ("2", "A", 21.0), ("3", "B", 30.0), ("3", "B", 31.0)], "patient_id string, device_model string, measurement_value double")
    r = one(m.repeatability(df))
    assert r["within_subject_sd"] == pytest.approx(math.sqrt(0.5)) and r["repeatability_coefficient"] == pytest.approx(2.77 * math.sqrt(0.5)) and (r["n_repeated_subjects"], r["n_devices"], r["between_device_mean_bias"]) == (3, 2, None)
    two = spark.createDataFrame([(p, d, b + x) for p, b in (("1", 10.0), ("2", 20.0)) for d, x in (("A", 0.0), ("A", 0.2 if p == "1" else 0.1), ("B", 1.0), ("B", 1.2 if p == "1" else 1.1))], "patient_id string, device_model string, measurement_value double")
    assert one(m.repeatability(two))["between_device_mean_bias"] == pytest.approx(1.0)


def test_temporal_stability(spark):
    df = spark.createDataFrame([(s, v) for s, v in (("a", 10.0), ("b", 11.0), ("c", 12.0)) for _ in range(2)], "session_id string, measurement_value double")
    r = one(m.temporal_stability(df))
    assert r["max_abs_relative_drift_percent"] == pytest.approx(20) and r["linear_drift_per_session"] == pytest.approx(1)


def test_residuals(spark):
    df = frame(spark, [(str(i), float(i), 1.1 * i) for i in range(5, 15)])
    r = one(m.residual_diagnostics(df))
    assert r["mean_residual"] == pytest.approx(0.95) and r["spearman_reference_residual"] > 0.9
    assert m.residual_strata(m.paired(df)).count() == 4
    with pytest.raises(ValueError):
        m.residual_strata(m.paired(frame(spark, [("a", 1.0, 1.0), ("b", 1.0, 2.0)])))


def test_method_comparison(spark):
    r = one(resampling.method_comparison(frame(spark, [(str(i), 10.0 + i, 1.05 * (10 + i) + 0.4) for i in range(10)])))
    assert r["deming_slope"] == pytest.approx(1.05) and r["deming_intercept"] == pytest.approx(0.4) and r["passing_bablok_slope"] == pytest.approx(1.05)


def test_slope_median_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 30, 101).astype(float), rng.normal(size=101)
    i, j = np.triu_indices(101, 1)
    use = x[i] != x[j]
    want = np.median(((y[j] - y[i])[use]) / ((x[j] - x[i])[use]))
    pairs = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "subject long, r double, m double")
    assert m.pairwise_slope_median(pairs) == pytest.approx(want)
    assert m.pairwise_slope_median(pairs, width=8, few=10) == pytest.approx(want)


def test_constant_measurement_has_no_correlation(spark):
    r = one(m.regression_metrics(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "y double, p double"), "y", "p"))
    assert r["pearson_r"] is None and r["r2"] == pytest.approx(-1)


def test_relative_change(spark):
    df = spark.createDataFrame([(2.0, 3.0), (0.0, 3.0), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(m.relative_mae_change(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.5 and got[1] == math.inf and math.isnan(got[2])


def test_intervals(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (2.0, 1.5, 2.5), (3.0, 3.5, 4.0), (4.0, 3.0, 4.5)], "y double, lo double, hi double")
    r = one(m.interval_metrics(df, "y", "lo", "hi"))
    assert (r["coverage"], r["mean_width"]) == (0.75, 1.25)
    assert [x["abstain"] for x in m.abstained(df, "lo", "hi", 1.4).collect()] == [True, False, False, True]


def test_grouped_regression(spark):
    df = spark.createDataFrame([(10.0, 11.0, "A"), (20.0, 19.0, "A"), (30.0, 31.0, "B"), (40.0, 39.0, "B")], "y double, p double, g string")
    assert rows(m.grouped_regression(df, "y", "p", "g").select("group", "n")) == [("A", 2), ("B", 2)]


def test_order_statistics(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    assert order_statistics(df, "x", [0, 17, 4999], small=50) == [np.sort(v)[k] for k in (0, 17, 4999)]
    assert quantiles(df, "x", [0, 0.25, 0.5, 1]) == pytest.approx(list(np.quantile(v, [0, 0.25, 0.5, 1])))
    assert quantiles(df.where("false"), "x", [0.5]) == []
    assert sorted(r["idx"] for r in indexed(df.distinct(), ["x"]).collect()) == list(range(len(np.unique(v))))
