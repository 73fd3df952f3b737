"""Regression baselines, colour calibration and model selection.

Linear models are solved from one aggregate of cross products, whose size is that of the features, not of the data;
forests and boosted trees are grown in tasks on exact splits (``functions/trees.py``) while a task can hold the rows, and others are
Spark's own learners. Rows with a null or infinite feature or target fail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.ordering import indexed
from ..functions.trees import boosted, forest_sum
from ..plans.staging import written
from .measurement import regression_metrics


@dataclass(frozen=True)
class LinearModel:
    """coefficients of the named features, and an intercept."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def expression(self) -> Column:
        return sum((F.lit(float(c)) * F.col(f).cast("double") for f, c in zip(self.features, self.coefficients, strict=True)), F.lit(float(self.intercept)))

    def predict(self, df: DataFrame, alias: str = "prediction") -> DataFrame:
        return df.withColumn(alias, self.expression())


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred cross products) of the columns. Means come first, so that the products keep their digits."""
    bad = ~finite(columns[0])
    for c in columns[1:]:
        bad = bad | ~finite(c)
    first = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), *(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns))).first()
    if not first["n"] or first["bad"]:
        raise ValueError("features and target must be finite, and there must be rows")
    mean = np.array([first[f"m{i}"] for i in range(len(columns))])
    x = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = df.agg(*(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = got[f"p{i}_{j}"]
    return first["n"], mean, out


def fit_ridges(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float]) -> list[LinearModel]:
    """Ridge for each alpha, from one aggregate, on features scaled by their population spread; a singular system gets its smallest solution."""
    products = cross_products(df, [*features, target])
    return [_ridge(features, *products, alpha) for alpha in alphas]


def _ridge(features: Sequence[str], n: int, mean: np.ndarray, s: np.ndarray, alpha: float) -> LinearModel:
    k = len(features)
    spread = np.sqrt(np.maximum(np.diag(s)[:k], 0) / n)
    spread[spread == 0] = 1.0
    gram = s[:k, :k] / np.outer(spread, spread) + alpha * np.eye(k)
    c = np.linalg.pinv(gram, hermitian=True) @ (s[:k, k] / spread) / spread
    return LinearModel(tuple(features), tuple(map(float, c)), float(mean[k] - mean[:k] @ c))


def fit_linear(df: DataFrame, features: Sequence[str], target: str, alpha: float = 0.0) -> LinearModel:
    """Least squares, or ridge with ``alpha``."""
    return fit_ridges(df, features, target, [alpha])[0]


def fit_lasso(df: DataFrame, features: Sequence[str], target: str, alpha: float = 0.01, passes: int = 10_000) -> LinearModel:
    """Lasso on scaled features, by coordinate descent on the cross products."""
    n, mean, s = cross_products(df, [*features, target])
    k = len(features)
    spread = np.sqrt(np.diag(s)[:k] / n)
    spread[spread == 0] = 1.0
    gram, xy, c = s[:k, :k] / np.outer(spread, spread) / n, s[:k, k] / spread / n, np.zeros(k)
    for _ in range(passes):
        before = c.copy()
        for j in range(k):
            if gram[j, j] > 0:
                rho = xy[j] - gram[j] @ c + gram[j, j] * c[j]
                c[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
        if np.abs(c - before).max() < 1e-12:
            break
    c = c / spread
    return LinearModel(tuple(features), tuple(map(float, c)), float(mean[k] - mean[:k] @ c))


def tree_learners(seed: int = 42, trees: int = 300, rounds: int = 200) -> dict[str, Any]:
    """Forest and boosting with the baselines' settings; all features are tried at each split."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    return {
        "random_forest": RandomForestRegressor(numTrees=trees, minInstancesPerNode=2, maxDepth=30, featureSubsetStrategy="all", seed=seed),
        "gradient_boosting": GBTRegressor(maxIter=rounds, stepSize=0.05, maxDepth=2, seed=seed),
    }


def fitted(name: str, train: DataFrame, features: Sequence[str], target: str, learners: Mapping[str, Any] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A baseline (linear, ridge, lasso, or a learner) fitted once; it gives a table its predictions."""
    linear = {"linear": lambda: fit_linear(train, features, target), "ridge": lambda: fit_linear(train, features, target, 1.0), "lasso": lambda: fit_lasso(train, features, target)}
    if name in linear:
        return linear[name]().predict
    return _learned((learners or tree_learners())[name], train, features, target)


#: Values (rows times features) up to which a task holds a training table, about 60 bytes each, and the table that is predicted.
MOST_VALUES = 8_000_000


def _learned(learner: Any, train: DataFrame, features: Sequence[str], target: str) -> Callable[[DataFrame], DataFrame]:
    settings, most = _tree_settings(learner), MOST_VALUES // len(features)
    if settings is None or _finite_rows(train, [*features, target]) > most:
        return _by_spark(learner, train, features, target)
    predict = lambda df: _by_tasks(settings, train, df, features, target)
    return lambda df: predict(df) if _finite_rows(df, features) <= most else _by_spark(learner, train, features, target)(df)


def _by_spark(learner: Any, train: DataFrame, features: Sequence[str], target: str) -> Callable[[DataFrame], DataFrame]:
    from pyspark.ml.feature import VectorAssembler

    put = VectorAssembler(inputCols=list(features), outputCol="_features")
    model = learner.copy().setLabelCol(target).setFeaturesCol("_features").setPredictionCol("prediction").fit(put.transform(train))
    return lambda df: model.transform(put.transform(df)).drop("_features")


def _finite_rows(df: DataFrame, columns: Sequence[str]) -> int:
    n, good = df.agg(F.count("*"), F.count_if(reduce(Column.__and__, map(finite, columns)))).first()
    if not n or good < n:
        raise ValueError("features and target must be finite, and there must be rows")
    return n


def _tree_settings(learner: Any) -> dict[str, Any] | None:
    """What growing trees in tasks needs to know of a forest or of boosting; null for other learners and for settings that only Spark's have."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    forest = isinstance(learner, RandomForestRegressor)
    if not (forest or isinstance(learner, GBTRegressor)) or learner.getSubsamplingRate() != 1.0 or learner.getMinInfoGain() or learner.getMinWeightFractionPerNode() or learner.isDefined("weightCol"):
        return None
    each = {"depth": learner.getMaxDepth(), "least": learner.getMinInstancesPerNode()}
    if forest:
        return each | {"trees": learner.getNumTrees(), "seed": learner.getSeed()} if learner.getFeatureSubsetStrategy() == "all" and learner.getBootstrap() else None
    return each | {"rounds": learner.getMaxIter(), "step": learner.getStepSize()} if learner.getFeatureSubsetStrategy() == "all" and learner.getLossType() == "squared" and not learner.isDefined("validationIndicatorCol") else None


def _by_tasks(settings: Mapping[str, Any], train: DataFrame, df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``df`` with its prediction. Each task has both tables and grows trees of its own, or the one series of boosted trees; only sums of predictions leave it.

    Training rows are put in the order of their values first, so that draws don't depend on how tables are parted.
    """
    trees, k = settings.get("trees", 1), len(features)
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    asked = written(df.withColumn("_row", F.monotonically_increasing_id()), "asked")
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    both = train.select(F.lit(-1).cast("long").alias("row"), F.col(target).cast("double").alias("y"), *x).unionAll(asked.select("_row", F.lit(0.0), *x))
    rest = {name: v for name, v in settings.items() if name != "trees"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        task, row, y = held.column("task")[0].as_py(), held.column("row").to_numpy(), held.column("y").to_numpy()
        table = np.stack([held.column(f"x{i}").to_numpy() for i in range(k)])
        del held
        known = np.flatnonzero(row < 0)
        known = known[np.lexsort((*table[:, known], y[known]))]
        given, ask = (table[:, known], y[known]), table[:, row >= 0]
        total = forest_sum(*given, ask, range(task, trees, tasks), **rest) if "rounds" not in rest else boosted(*given, ask, **rest)
        yield pa.RecordBatch.from_arrays([pa.array(row[row >= 0]), pa.array(total)], names=["_row", "total"])

    parts = both.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "*").repartitionById(tasks, "task").mapInArrow(run, "_row long, total double")
    predicted = parts.groupBy("_row").agg((F.sum("total") / trees).alias("prediction"))
    return asked.join(predicted, "_row").drop("_row")


def fit_predict(name: str, train: DataFrame, test: DataFrame, features: Sequence[str], target: str, learners: Mapping[str, Any] | None = None) -> DataFrame:
    """``test`` with the prediction of a baseline: linear, ridge, lasso, or a learner."""
    return fitted(name, train, features, target, learners)(test)


def fit_and_evaluate(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, models: Sequence[str] = ("linear", "ridge", "lasso"), learners: Mapping[str, Any] | None = None) -> DataFrame:
    """Error metrics of each model on ``test``, best first."""
    parts = [regression_metrics(fit_predict(m, train, test, features, target, learners), target, "prediction", model=m) for m in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("mae")


def fit_affine(df: DataFrame, observed: Sequence[str], reference: Sequence[str], partition: str) -> list[LinearModel]:
    """A 4x3 affine map of observed to reference colours; only fitted on train or calibration, with three rows or more."""
    if partition not in ("train", "calibration"):
        raise ValueError("calibration is fitted on train or calibration data only")
    if df.limit(3).count() < 3:
        raise ValueError("at least three rows are required")
    return [fit_linear(df, observed, r) for r in reference]


def apply_affine(df: DataFrame, maps: Sequence[LinearModel], names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: m.expression() for n, m in zip(names, maps, strict=True)})


def affine_rmse(df: DataFrame, maps: Sequence[LinearModel], reference: Sequence[str]) -> float:
    squares = [(m.expression() - F.col(r)) * (m.expression() - F.col(r)) for m, r in zip(maps, reference, strict=True)]
    return float(df.agg(F.sqrt(F.avg(sum(squares[1:], squares[0])) / len(squares))).first()[0])


def group_folds(df: DataFrame, group: str, folds: int, alias: str = "fold") -> DataFrame:
    """``df`` with a fold for each row, groups whole: groups in order of size, then name, go to and fro over the folds, so that totals stay near.

    Places are counted in sorted ranges, so that no task holds all groups. Fewer groups than folds fail.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size")).withColumn("_less", -F.col("_size"))
    ranked = indexed(sizes, ["_less", group], "_rank")
    if ranked.count() < folds:
        raise ValueError("there are fewer groups than folds")
    turn, place = F.expr(f"_rank div {folds}") % 2, F.col("_rank") % folds
    fold = F.when(turn == 0, place).otherwise(folds - 1 - place).cast("int")
    return df.join(ranked.select(group, fold.alias(alias)), group)


def _inner_folds(groups: DataFrame, group: str, outer: int, inner: int) -> DataFrame:
    """(group, _o, _part): the inner fold of each training group of each outer fold, as ``group_folds`` deals them; ``groups`` is (group, _size, _outer)."""
    each = groups.select(group, (-F.col("_size")).alias("_less"), "_outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("_o")).where("_outer <> _o")
    placed = indexed(each.select(group, "_less", "_o"), ["_o", "_less", group], "_rank")
    first = placed.groupBy("_o").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    if not first.where(F.col("_n") < inner).isEmpty():
        raise ValueError("there are fewer groups than folds")
    rank = F.col("_rank") - F.col("_first")
    turn = F.floor(rank / inner) % 2
    return placed.join(first, "_o").select(group, "_o", F.when(turn == 0, rank % inner).otherwise(inner - 1 - rank % inner).cast("int").alias("_part"))


def nested_group_cv(df: DataFrame, features: Sequence[str], target: str, group: str, alphas: Sequence[float] = (0.1, 1.0, 10.0), outer: int = 5, inner: int = 4) -> DataFrame:
    """(fold, alpha, mae, rmse) of ridge regression: in each outer fold the alpha that does best over inner folds of its training groups.

    Cross products add up, so one aggregate by fold gives those of every training set, and one more the errors of all candidates.
    """
    if outer < 2 or inner < 2 or not alphas:
        raise ValueError("two folds or more and a candidate are required")
    columns = [*features, target]
    _, shift, _ = cross_products(df, columns)
    placed = written(group_folds(df, group, outer, "_outer"), "folds")
    groups = placed.groupBy(group, "_outer").agg(F.count("*").alias("_size"))
    inside = written(_inner_folds(groups, group, outer, inner), "inner")
    rows = placed.select(group, *(F.col(c).cast("double").alias(c) for c in columns)).join(inside, group)
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, shift, strict=True)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.groupBy("_o", "_part").agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs)).collect()

    def products(of: Sequence[Any]) -> tuple[int, np.ndarray, np.ndarray]:
        n, s = sum(r["n"] for r in of), np.array([sum(r[f"s{i}"] for r in of) for i in range(len(columns))])
        p = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            p[i, j] = p[j, i] = sum(r[f"p{i}_{j}"] for r in of)
        return n, shift + s / n, p - np.outer(s, s) / n

    def table(models: Sequence[tuple], keys: str) -> DataFrame:
        rows_ = [(*key, [*m.coefficients, m.intercept]) for *key, m in models]
        return df.sparkSession.createDataFrame(rows_, f"{keys}, _coef array<double>")

    fitted_ = sum((F.col("_coef")[i] * F.col(f).cast("double") for i, f in enumerate(features)), F.col("_coef")[len(features)])
    e = fitted_ - F.col(target)
    tried = [(o, i, j, _ridge(features, *products([r for r in sums if r["_o"] == o and r["_part"] != i]), a)) for o in range(outer) for i in range(inner) for j, a in enumerate(alphas)]
    errors = rows.join(table(tried, "_o int, _part int, _try int"), ["_o", "_part"]).groupBy("_o", "_part", "_try").agg(F.avg(F.abs(e)).alias("mae")).collect()
    loss = {(o, j): sum(r["mae"] for r in errors if r["_o"] == o and r["_try"] == j) for o in range(outer) for j in range(len(alphas))}
    best = [min(range(len(alphas)), key=lambda j, o=o: (loss[o, j], alphas[j])) for o in range(outer)]
    final = [(o, float(alphas[best[o]]), _ridge(features, *products([r for r in sums if r["_o"] == o]), alphas[best[o]])) for o in range(outer)]
    tested = placed.join(table(final, "_outer int, _alpha double"), "_outer")
    return tested.groupBy(F.col("_outer").alias("fold"), F.col("_alpha").alias("alpha")).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def nested_learner_cv(df: DataFrame, features: Sequence[str], target: str, group: str, learner: Any, grid: Sequence[Mapping[Any, Any]], outer: int = 5, inner: int = 4) -> DataFrame:
    """(fold, choice, mae, rmse) of any learner of Spark's: in each outer fold the parameters of ``grid``, by position, that do best over inner folds of its training groups."""

    def candidates(train: DataFrame) -> list[Callable[[DataFrame], DataFrame]]:
        return [_learned(learner.copy(dict(p)), train, features, target) for p in grid]

    return _nested(df, target, group, candidates, list(range(len(grid))), "choice", outer, inner)


def _nested(df: DataFrame, target: str, group: str, candidates: Callable[[DataFrame], list[Callable[[DataFrame], DataFrame]]], names: Sequence[Any], label: str, outer: int, inner: int) -> DataFrame:
    if outer < 2 or inner < 2 or not names:
        raise ValueError("two folds or more and a candidate are required")
    placed = written(group_folds(df, group, outer, "_outer"), "folds")
    e = F.col("prediction") - F.col(target)
    parts = []
    for o in range(outer):
        train, test = placed.where(F.col("_outer") != o).drop("_outer"), placed.where(F.col("_outer") == o)
        split = written(group_folds(train, group, inner, "_inner"), "folds")
        loss = [0.0] * len(names)
        for i in range(inner):
            held = split.where(F.col("_inner") == i)
            errors = [m(held).select((F.abs(e)).alias("e"), F.lit(j).alias("j")) for j, m in enumerate(candidates(split.where(F.col("_inner") != i)))]
            for r in reduce(DataFrame.union, errors).groupBy("j").agg(F.avg("e").alias("mae")).collect():
                loss[r["j"]] += r["mae"]
        best = min(range(len(names)), key=lambda j: (loss[j], j))
        parts.append(candidates(train)[best](test).agg(F.lit(o).alias("fold"), F.lit(names[best]).alias(label), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")))
    return reduce(DataFrame.union, parts)
