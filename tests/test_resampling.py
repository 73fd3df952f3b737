import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.slopes import median_slope
from lumenframe.operators import resampling as r
from tests.conftest import one, rows

Y, P = [10.0, 12.0, 15.0, 18.0, 21.0, 25.0], [10.5, 11.5, 15.5, 17.0, 22.0, 24.0]


def drawn(seed, rep, n):
    return [int(hashlib.md5(f"{seed}-{rep}-{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(f"s{i}", a, b) for i, (a, b) in enumerate(zip(Y, P, strict=True))], "subject string, r double, m double")


def test_agreement_bootstrap_matches_numpy(spark, pairs):
    got = {x["metric"]: x for x in r.agreement_bootstrap(pairs, replicates=100).collect()}
    e = np.array(P) - np.array(Y)
    bias = [e[drawn(42, k, 6)].mean() for k in range(100)]
    sd = [e[drawn(42, k, 6)].std(ddof=1) for k in range(100)]
    assert got["bias"]["estimate"] == pytest.approx(-1 / 12)
    assert (got["bias"]["lower"], got["bias"]["upper"]) == pytest.approx(tuple(np.quantile(bias, [0.025, 0.975])))
    assert got["loa_low"]["lower"] == pytest.approx(np.quantile(np.array(bias) - 1.96 * np.array(sd), 0.025))


def test_clusters_are_drawn_whole(spark):
    df = spark.createDataFrame([(10.0, 11.0, "a"), (11.0, 10.0, "a"), (20.0, 19.0, "b"), (21.0, 22.0, "b"), (30.0, 29.0, "c"), (31.0, 32.0, "c")], "y double, p double, g string")
    got = {x["metric"]: x for x in r.cluster_bootstrap(df, "y", "p", "g", replicates=200).collect()}
    assert got["mae"]["n_units"] == 3 and got["mae"]["estimate"] == got["mae"]["lower"] == got["mae"]["upper"] == 1
    again = {x["metric"]: x for x in r.cluster_bootstrap(df.repartition(3), "y", "p", "g", replicates=200).collect()}
    assert got == again
    with pytest.raises(ValueError):
        r.cluster_bootstrap(df.where("g = 'a'"), "y", "p", "g")


def test_permutation(spark):
    df = spark.createDataFrame([(i, 10.0 + 2 * i, p) for i, p in enumerate([11.0, 11.0, 13.0, 17.0, 17.0])], "id long, y double, p double")
    a = one(r.permutation_test(df, "y", "p", "id", permutations=200))
    assert 0 < a["p_value"] <= 1 and a["observed"] == pytest.approx(1) and a == one(r.permutation_test(df, "y", "p", "id", permutations=200))


def test_conformal(spark):
    df = spark.createDataFrame([(0.0, float(i)) for i in range(1, 11)], "y double, p double")
    c = one(r.split_conformal(df, "y", "p", 0.2))
    assert c["quantile"] == 9 and c["n"] == 10
    out = r.predict_interval(df, "p", r.split_conformal(df, "y", "p", 0.2)).collect()
    assert all(x["upper"] - x["lower"] == 18 for x in out)
    assert r.conformal_rank(3, 0.01) == 3 and r.conformal_rank(1, 0.9) == 1
    with pytest.raises(ValueError):
        r.split_conformal(df.where("false"), "y", "p")


def test_interval_calibration(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0, "a"), (2.0, 1.5, 2.5, "b"), (3.0, 3.5, 4.0, "c"), (4.0, 3.0, 4.5, "d")], "y double, lo double, hi double, s string")
    x = one(r.interval_calibration(df, "y", "lo", "hi", 0.25, "s", replicates=100))
    assert x["observed_coverage"] == 0.75 and x["coverage_error"] == pytest.approx(0) and x["mean_width"] == 1.25


def test_slope_bootstrap(spark, pairs):
    got = {x["metric"]: x for x in r.slope_bootstrap(pairs, replicates=20).collect()}
    assert set(got) == {"deming_slope", "deming_intercept", "passing_bablok_slope", "passing_bablok_intercept"} and got["deming_slope"]["lower"] <= got["deming_slope"]["upper"]
    with pytest.raises(ValueError):
        r.slope_bootstrap(pairs, most_units=3)


def brute_slope(x, y, times):
    x, y = np.repeat(x, times), np.repeat(y, times)
    i, j = np.triu_indices(len(x), 1)
    use = x[i] != x[j]
    return np.median((y[j] - y[i])[use] / (x[j] - x[i])[use]) if use.any() else np.nan


def test_median_slope_matches_all_pairs():
    for seed in range(60):
        g = np.random.default_rng(seed)
        n = int(g.integers(2, 300))
        x = g.integers(0, 5, n) * 1.0 if seed % 5 == 0 else g.normal(25, 0.5, n)
        y = x + g.normal(0, 0.1, n) if seed % 3 else np.round(x, 1)
        times = g.integers(1, 4, n)
        assert median_slope(x, y, times, few=1, sample=64, chunk=1000) == pytest.approx(brute_slope(x, y, times), rel=1e-12, nan_ok=True)


def test_slope_bootstrap_matches_numpy(spark, pairs):
    got = {x["metric"]: x for x in r.slope_bootstrap(pairs, replicates=50).collect()}
    slopes = [brute_slope(np.array(Y)[d], np.array(P)[d], 1) for d in (drawn(42, k, 6) for k in range(50)) if len(set(d)) > 1]
    assert (got["passing_bablok_slope"]["lower"], got["passing_bablok_slope"]["upper"]) == pytest.approx(tuple(np.quantile(slopes, [0.025, 0.975])))


def test_slope_bootstrap_of_more_than_20000_subjects(spark):
    many = spark.range(20_001).selectExpr("id as subject", "id / 1000D as r", "2 * id / 1000D + pmod(xxhash64(id), 1000) / 1000D as m")
    got = {x["metric"]: x for x in r.slope_bootstrap(many, replicates=4).collect()}
    assert got["passing_bablok_slope"]["n_defined"] == 4 and got["passing_bablok_slope"]["lower"] == pytest.approx(2, abs=0.01)


def test_registered_queries_take_2000_replicates(spark, small):
    import __spark_entry__ as entry

    q = entry.queries()
    for name in ("row_bootstrap", "cluster_bootstrap", "agreement_bootstrap", "benchmark_report"):
        assert {x["n_bootstrap"] for x in q[name](spark, small).collect()} == {2000}
    assert {x["n_defined"] for x in q["slope_bootstrap"](spark, small).collect()} == {2000}
    p = one(q["permutation_test"](spark, small))
    assert p["n_permutations"] == 2000 and round(p["p_value"] * 2001) == pytest.approx(p["p_value"] * 2001, abs=0.01)
    tests = [x["p_value"] for x in q["benchmark_report"](spark, small).collect() if x["p_value"] is not None]
    assert len(tests) == 2 and min(tests) < 1 / 51


def test_registered_bootstraps_match_their_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{small}/lineitem.parquet'")
    for name in ("row_bootstrap", "cluster_bootstrap", "agreement_bootstrap", "interval_calibration", "permutation_test"):
        df = entry.queries()[name](spark, small)
        want = duck.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
        got = sorted(map(tuple, df.collect()), key=repr)
        assert len(got) == len(want)
        for a, b in zip(got, sorted(want, key=repr), strict=True):
            assert a == pytest.approx(b, abs=2e-6)


def test_order_statistics_with_infinities_and_steps(spark):
    from lumenframe.functions.ordering import order_statistics, quantiles

    inf = float("inf")
    values = [float(i % 37) for i in range(60)] + [1e300, -1e300, inf, inf, -inf, 5e-324, 1e15, 1e15 + 0.125]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    assert order_statistics(df, "v", range(len(values)), small=5) == sorted(values)
    assert quantiles(df, "v", [0.0, 1.0]) == [-inf, inf]
    with pytest.raises(ValueError):
        order_statistics(df, "v", [len(values)])
    with pytest.raises(ValueError):
        order_statistics(spark.createDataFrame([(float("nan"),)], "v double"), "v", [0])


def test_permutations_in_ranges_are_the_same(spark, monkeypatch):
    from lumenframe.operators import resampling

    df = spark.createDataFrame([(i, float(i), float((i * 7) % 50)) for i in range(50)], "id long, y double, p double")
    want = rows(resampling.permutation_tests(df, "y", "p", "id", permutations=30))
    monkeypatch.setattr(resampling, "PER_RANGE", 7)
    got = rows(resampling.permutation_tests(df, "y", "p", "id", permutations=30))
    assert [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_slope_replicates_are_replaced(spark):
    flat = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 3.0)], "subject string, r double, m double")
    got = {q["metric"]: q for q in r.slope_bootstrap(flat, 40).collect()}
    assert all(q["n_defined"] == 40 for q in got.values())
    with pytest.raises(ValueError, match="too few"):
        r.slope_bootstrap(flat.withColumn("r", F.lit(1.0)), 10)


def test_slope_median_in_one_task_and_by_blocks(spark, monkeypatch):
    from lumenframe.operators import measurement

    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 30, 200).astype(float), rng.normal(size=200)
    df = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "subject string, r double, m double")
    want = np.median([(y[j] - y[i]) / (x[j] - x[i]) for i in range(200) for j in range(i) if x[i] != x[j]])
    assert measurement.slope_median(df) == pytest.approx(want)
    monkeypatch.setattr(measurement, "ONE_TASK", 10)
    assert measurement.slope_median(df) == pytest.approx(want)


def test_stacked_ranks(spark):
    from lumenframe.operators import measurement

    df = spark.createDataFrame([(1, 3.0, 2.0), (2, 1.0, None), (3, 3.0, 5.0), (4, None, 2.0)], "i int, x double, y double")
    got = {q["i"]: (q["rank_x"], q["rank_y"]) for q in measurement.stacked_ranks(df, ("x", "y")).collect()}
    assert got == {1: (2.5, 1.5), 2: (1.0, None), 3: (2.5, 3.0), 4: (None, 1.5)}


def test_draws_and_orders_are_those_of_md5():
    from lumenframe.functions.draws import Digests

    n = 20_011
    d = Digests(n)
    for prefix in ("42-7-", "42-1999-", "7-12-"):
        text = [hashlib.md5(f"{prefix}{i}".encode()).hexdigest() for i in range(n)]
        assert d.drawn(prefix, 977).tolist() == [int(t[:8], 16) % 977 for t in text]
        assert d.order(prefix).tolist() == sorted(range(n), key=lambda i: (text[i], i))


def test_replicates_in_tasks_equal_those_in_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, f"c{i % 9}", None if i % 13 == 0 or i % 9 == 4 else float(a), float("inf") if i == 5 else float(b)) for i, (a, b) in enumerate(rng.normal(10, 2, (90, 2)))]
    df = spark.createDataFrame(data, "id long, g string, y double, p double")
    both = lambda: (rows(r.cluster_bootstrap(df, "y", "p", "g", replicates=100)), rows(r.permutation_tests(df.where("id <> 5"), "y", "p", "id", permutations=40)))
    monkeypatch.setattr(r, "PER_TASK", 500)
    here = both()
    monkeypatch.setattr(r, "MOST_UNITS", 0)
    monkeypatch.setattr(r, "MOST_ROWS", 0)
    for a, b in zip(here, both(), strict=True):
        for one_, other in zip(a, b, strict=True):
            assert one_ == pytest.approx(other, nan_ok=True)


def test_replicates_that_fit_in_tasks_move_nothing(spark, monkeypatch):
    """No row of a permutation and no draw is a row of a table."""
    df = spark.range(500).selectExpr("id", "cast(id as double) as y", "cast((id * 7) % 500 as double) as p")
    plan = r.permutation_tests(df, "y", "p", "id", permutations=2000)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "md5" not in plan
    made = []
    monkeypatch.setattr(r, "draws", lambda *a: made.append(a))
    assert r.cluster_bootstrap(df, "y", "p", "id", replicates=200).count() == 4 and not made
