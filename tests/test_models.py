import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import cli
from lumenframe.operators import models as m
from lumenframe.plans import experiments as e
from lumenframe.streaming.drift import drained, first_deliveries, session_means
from tests.conftest import one


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1] + [0, 10, 3]
    y = x @ [2.0, -0.5, 7.0] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(f"p{i % 40}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "g string, a double, b double, c double, y double")
    return x, y, df


def test_linear_and_ridge(data):
    x, y, df = data
    fit = m.fit_linear(df, ["a", "b", "c"], "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0]
    assert [*fit.coefficients, fit.intercept] == pytest.approx(list(want))
    z = (x - x.mean(0)) / x.std(0)
    ridge = np.linalg.solve(z.T @ z + 5 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert list(m.fit_linear(df, ["a", "b", "c"], "y", 5.0).coefficients) == pytest.approx(list(ridge))
    lasso = m.fit_lasso(df, ["a", "b", "c"], "y", 0.01)
    grad = z.T @ (y - (x @ lasso.coefficients + lasso.intercept)) / 200
    assert np.abs(grad) == pytest.approx(0.01, abs=1e-6)
    assert set(m.fit_lasso(df, ["a", "b"], "y", 1e6).coefficients) == {0.0}
    with pytest.raises(ValueError):
        m.fit_linear(df.withColumn("a", df.a / 0.0 if False else df.a * float("inf")), ["a"], "y")


def test_evaluation_and_trees(data):
    _, _, df = data
    learners = m.tree_learners(trees=5, rounds=5)
    learners["random_forest"].setMaxDepth(5)
    out = m.fit_and_evaluate(df, df, ["a", "b", "c"], "y", ("linear", "lasso", "random_forest"), learners).collect()
    assert out[0]["model"] in ("linear", "lasso") and len(out) == 3 and all(r["n"] == 200 for r in out)


def test_affine(spark):
    rng = np.random.default_rng(1)
    obs = rng.random((20, 3))
    ref = obs @ [[0.9, 0.1, 0], [0, 0.8, 0.1], [0.05, 0, 1.1]] + [0.01, 0.02, 0.03]
    df = spark.createDataFrame([(*map(float, o), *map(float, r)) for o, r in zip(obs, ref, strict=True)], "r double, g double, b double, x double, y double, z double")
    maps = m.fit_affine(df, "rgb", "xyz", "calibration")
    assert m.affine_rmse(df, maps, "xyz") < 1e-9
    with pytest.raises(ValueError):
        m.fit_affine(df, "rgb", "xyz", "test")
    with pytest.raises(ValueError):
        m.fit_affine(df.limit(2), "rgb", "xyz", "train")


def test_group_folds_and_nested_selection(data):
    _, _, df = data
    f = m.group_folds(df, "g", 4)
    assert f.groupBy("g").agg({"fold": "count"}).count() == 40 and f.select("g", "fold").distinct().count() == 40
    assert {r["count"] for r in f.groupBy("fold").count().collect()} == {50}
    cv = m.nested_group_cv(df, ["a", "b", "c"], "y", "g", (0.1, 1000.0), 2, 2).collect()
    assert len(cv) == 2 and all(r["alpha"] == 0.1 and r["mae"] < 0.2 for r in cv)


def partition(spark, ids):
    row = lambda i: (f"p{i}", f"img{i}", f"acq{i}", "hemoglobin", 10 + 0.12 * i, "g/dL", "lab", "cbc", f"ref{i}", "laboratory", "A", 1000.0, 100.0, "locked", 100.0, 5.0, "flash", "conjunctiva", 10.0, 10.0, 60.0, 60.0, 100.0, 100.0, 0.2 + 0.02 * i, 0.4 + 0.01 * i)
    return spark.createDataFrame([row(i) for i in ids], "patient_id string, image_id string, acquisition_id string, biomarker string, target_value double, target_unit string, target_source string, reference_method string, reference_measurement_id string, reference_type string, device_model string, exposure_us double, iso double, white_balance_mode string, working_distance_mm double, incidence_angle_deg double, illumination string, roi_type string, roi_x0 double, roi_y0 double, roi_x1 double, roi_y1 double, image_width double, image_height double, f1 double, f2 double")


def test_experiment(spark):
    train, cal, test = partition(spark, range(12)), partition(spark, range(12, 20)), partition(spark, range(20, 30))
    config = e.ExperimentConfig(("f1", "f2"), n_bootstrap=100, n_permutations=20, max_interval_width=100.0)
    r = e.scientific_experiment(train, cal, test, config)
    assert r["passed"] and r["n"] == {"train": 12, "calibration": 8, "test": 10} and 0 <= r["uncertainty"]["coverage"] <= 1 and r["uncertainty"]["quantile"] >= 0 and r["abstained"] == 0 and set(r["benchmark"]) == {"mae", "rmse", "r2", "pearson_r"}
    with pytest.raises(ValueError, match="overlap"):
        e.scientific_experiment(train, cal, test.union(partition(spark, [3])), config)
    from pyspark.sql import functions as F

    bad = e.quantitative_report(test.withColumn("roi_type", F.lit("elbow")).withColumn("prediction", F.lit(12.0)), train, config)
    assert not bad["passed"] and bad["benchmark"] is None and any(x.startswith("roi_unsupported") for x in bad["errors"])
    with pytest.raises(ValueError):
        e.ExperimentConfig((), alpha=2)


def test_manifest_hash():
    ids = dict.fromkeys(e.MANIFEST, "x")
    assert e.manifest_hash(**ids, random_seed=1) == e.manifest_hash(random_seed=1, **dict(reversed(ids.items()))) != e.manifest_hash(**ids | {"model": "y"}, random_seed=1)
    for bad in ({**ids, "random_seed": -1}, {**ids, "model": " ", "random_seed": 1}, {**ids, "colour": "x", "random_seed": 1}, {"model": "x", "random_seed": 1}):
        with pytest.raises(ValueError):
            e.manifest_hash(**bad)


def test_content_version(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert e.content_version(df) == e.content_version(df.orderBy(F.desc("i"))) != e.content_version(df.limit(1))
    assert e.content_version(df.limit(0)).startswith("0-")


def test_frozen_external(spark):
    df = spark.createDataFrame([(1.0, 1.5, 0.0, 2.0), (2.0, 2.0, 2.5, 3.0)], "y double, p double, lo double, hi double")
    r = one(e.frozen_external(df, "y", "p", "m", "lo", "hi"))
    assert (r["n"], r["mae"], r["coverage"], r["model"]) == (2, 0.25, 0.5, "m") and "coverage" not in e.frozen_external(df, "y", "p", "m").columns
    with pytest.raises(ValueError):
        e.frozen_external(df, "y", "p", "m", "lo")


def test_nested_selection_of_any_learner(spark):
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), f"g{i % 9}") for i in range(45)], "x double, y double, g string")
    lr = LinearRegression()
    got = m.nested_learner_cv(df, ["x"], "y", "g", lr, [{lr.regParam: 100.0}, {lr.regParam: 0.0}], 3, 2).collect()
    assert len(got) == 3 and all(r["choice"] == 1 and r["mae"] < 2 for r in got)
    with pytest.raises(ValueError):
        m.group_folds(df.where("g = 'g1'"), "g", 2)


def test_streams(spark, tmp_path):
    from datetime import datetime

    src = spark.createDataFrame([(datetime(2024, 1, d, 5), float(d), d) for d in (1, 1, 2, 3, 9)], "ts timestamp, value double, k int")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    got = {r["session"].day: (r["n"], r["mean"]) for r in drained(session_means(read()), spark, "sessions").collect()}
    assert got == {1: (2, 1.0), 2: (1, 2.0), 3: (1, 3.0)}
    assert drained(first_deliveries(read(), ["k"], "ts"), spark, "firsts").count() == 4


def test_command_line(spark, tmp_path, capsys):
    raw = tmp_path / "raw.csv"
    raw.write_text("pid,file,hb\n" + "\n".join(f"p{i},x{i}.jpg,{12 + i / 10}" for i in range(8)))
    (tmp_path / "map.yaml").write_text("columns:\n  patient_id: pid\n  image_path: file\n  target_value: hb\n")
    report = str(tmp_path / "r.json")
    assert cli.main(["discover", "--input", str(raw), "--report", report]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["candidates"]["target_value"] == ["hb"]
    assert cli.main(["canonicalize", "--input", str(raw), "--mapping", str(tmp_path / "map.yaml"), "--dataset", "d", "--output", str(tmp_path / "canon.parquet.csv"), "--report", report]) == 0
    assert cli.main(["participant-preflight", "--input", str(raw)]) == 1
    assert "failed" in capsys.readouterr().out
    folder = tmp_path / "canon.csv"
    spark.read.option("header", True).csv(str(tmp_path / "canon.parquet.csv")).toPandas().to_csv(folder, index=False)
    assert cli.main(["split", "--input", str(folder), "--output", str(tmp_path / "split")]) == 0
    assert cli.main(["physics-audit", "--input", str(folder), "--output", str(tmp_path / "phys"), "--report", report]) == 1
    assert cli.main(["audit", "--input", str(folder), "--output", str(tmp_path / "audit"), "--report", report]) == 1
    assert json.loads((tmp_path / "r.json").read_text())["checks"]["all_images_exist"] is False


def test_entry_has_every_core_query(spark, small):
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 70
    assert one(entry.entry(spark))["n_pairs"] > 0


def test_stream_sessions_keep_the_last_days(spark, folder):
    from datetime import datetime

    import __spark_entry__ as entry

    rows = [(datetime(2024, 1, d, 5), float(v)) for d, v in ((1, 1), (1, 3), (2, 2), (3, 3), (9, 5), (9, 7), (10, 4))]
    d = folder(events=spark.createDataFrame(rows, "ts timestamp, value double"))
    got = {r["session"].day: (r["n"], r["mean"]) for r in entry.queries()["stream_sessions"](spark, d).collect()}
    assert got == {1: (2, 2.0), 2: (1, 2.0), 3: (1, 3.0), 9: (2, 6.0), 10: (1, 4.0)}
    assert entry.queries()["stream_sessions"](spark, folder_of_no_rows(spark, d)).count() == 0


def folder_of_no_rows(spark, d):
    spark.read.parquet(f"{d}/events.parquet").limit(0).write.parquet(f"{d}/none/events.parquet")
    return f"{d}/none"


def test_last_states_over_batches(spark, tmp_path):
    """A window that grows over two batches is there once, as it is in the end."""
    from datetime import datetime

    from lumenframe.streaming.drift import last_states

    src = [spark.createDataFrame([(datetime(2024, 1, d, 5), float(d + k)) for d in days], "ts timestamp, value double") for k, days in ((0, (1, 2)), (1, (2, 3)))]
    for s in src:
        s.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = last_states(session_means(stream), ["session"], str(tmp_path / "out"), str(tmp_path / "at"))
    assert got.columns == ["session", "n", "mean", "sd"]
    assert {r["session"].day: (r["n"], r["mean"]) for r in got.collect()} == {1: (1, 1.0), 2: (2, 2.5), 3: (1, 4.0)}


def test_registered_models_have_the_operators_sizes(spark, small, monkeypatch):
    from lumenframe.plans import experiments

    seen = {}
    monkeypatch.setattr(experiments.models, "fit_and_evaluate", lambda *a: seen.update(learners=a[5] if len(a) > 5 else experiments.models.tree_learners()) or spark.range(1))
    experiments.tree_baselines(spark, small)
    forest, boosting = seen["learners"]["random_forest"], seen["learners"]["gradient_boosting"]
    assert (forest.getNumTrees(), forest.getMaxDepth(), boosting.getMaxIter()) == (300, 30, 200)
    assert experiments.nested_selection(spark, small).count() == 5


def brute_tree(x, y, times, rows_, depth, least):
    """The tree by trying every split of every node: its value, or feature, threshold and both sides."""
    best = None
    for f in range(len(x)) if depth and y[rows_].min() < y[rows_].max() else ():
        values = np.unique(x[f][rows_])
        for a, b in zip(values[:-1], values[1:], strict=True):
            low, high = rows_[x[f][rows_] <= a], rows_[x[f][rows_] > a]
            if min(len(low), len(high)) >= least:
                n, m = times[low].sum(), times[high].sum()
                gain = n * m / (n + m) * (np.average(y[low], weights=times[low]) - np.average(y[high], weights=times[high])) ** 2
                if best is None or gain > best[0] + 1e-12:
                    best = gain, f, a + (b - a) / 2, low, high
    if best is None:
        return np.average(y[rows_], weights=times[rows_])
    return best[1], best[2], *(brute_tree(x, y, times, side, depth - 1, least) for side in best[3:])


def test_trees_equal_brute_force():
    from lumenframe.functions import trees as t

    for seed in range(20):
        g = np.random.default_rng(seed)
        n, depth, least = int(g.integers(2, 50)), int(g.integers(1, 12)), int(g.integers(1, 4))
        x = np.stack([g.normal(size=n), g.integers(0, 4, n) * 1.0, g.integers(0, 2, n) * 1.0])
        y, times, q = g.normal(size=n) + x[0], np.bincount(g.integers(0, n, n), minlength=n) * 1.0, g.normal(size=(3, 30))
        tree, want = brute_tree(x, y, times, np.flatnonzero(times), depth, least), []
        for ask in q.T:
            at = tree
            while isinstance(at, tuple):
                at = at[2] if ask[at[0]] <= at[1] else at[3]
            want.append(at)
        assert t.grown(x, t.sorted_rows(x), y, times, depth, least).predict(q) == pytest.approx(np.array(want))


def test_whole_forests_and_boosting_end_without_a_job_for_each_level(spark, data):
    """300 trees of depth 30 and 200 rounds take few jobs, and predictions don't depend on how tables are parted."""
    x, y, df = data
    tracker, learners = spark.sparkContext.statusTracker(), m.tree_learners()
    spark.sparkContext.setJobGroup("trees", "trees")
    got = {k: {tuple(r)[:5]: r["prediction"] for r in m.fit_predict(k, df, df, ["a", "b", "c"], "y", learners).collect()} for k in learners}
    assert len(tracker.getJobIdsForGroup("trees")) < 40
    spark.sparkContext.setJobGroup("other", "other")
    assert {tuple(r)[:5]: r["prediction"] for r in m.fit_predict("random_forest", df.repartition(3), df, ["a", "b", "c"], "y", learners).collect()} == pytest.approx(got["random_forest"])
    for p in got.values():
        assert np.mean([abs(v - k[4]) for k, v in p.items()]) < 0.5 < np.std(y)
    with pytest.raises(ValueError, match="finite"):
        m.fit_predict("random_forest", df.selectExpr("*", "if(a > 0, a, null) as d"), df, ["d"], "y", learners)
