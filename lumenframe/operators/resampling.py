"""Bootstrap, permutation and conformal inference.

Draws are functions of a seed, the replicate and the position, so that any engine and any partitioning gives the same
ones: ``draw`` is the first 32 bits of md5('seed-replicate-position') modulo the number of units. Units (rows,
subjects or clusters) are first reduced to sufficient statistics, which draws add up within tasks before anything
moves; rows are never copied. Empty or too small inputs fail; replicates whose metric can't be computed are null
and left out, and too few left make the interval null.

Where the units fit in a task, each task gets all of them and makes whole replicates of its own, so that nothing of a replicate
moves; beyond that (MOST_UNITS, MOST_ROWS) draws are rows that meet units in a shuffle, with the same answers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import Digests
from ..functions.numbers import beside
from ..functions.ordering import indexed, order_statistics
from ..functions.slopes import median_slope
from ..plans.staging import spread, written
from .measurement import compared, median, paired


def draw(seed: int, rep: Column, position: Column, units: int) -> Column:
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), rep.cast("string"), position.cast("string")).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.lit(units)


def draws(spark: SparkSession, units: int, replicates: int, seed: int, first: int = 0) -> DataFrame:
    """(rep, idx): the unit that each draw of each replicate takes, for ``replicates`` of them from number ``first`` on. Draws are numbered through, so that any range of them is made where it is used."""
    each = spark.range(first * units, (first + replicates) * units).select(F.expr(f"id div {units}").alias("rep"), (F.col("id") % units).alias("position"))
    return each.select("rep", draw(seed, F.col("rep"), F.col("position"), units).alias("idx"))


#: Units (170 bytes each) and rows (90 bytes each) up to which a task holds all of them, and draws that make a task worth while, where a replicate counts as 20,000 draws more.
MOST_UNITS, MOST_ROWS, PER_TASK = 2_000_000, 4_000_000, 5_000_000


def whole_replicates(placed: DataFrame, n: int, columns: Sequence[str], replicates: int, make: Callable[[dict[str, np.ma.MaskedArray], Sequence[int]], Iterable[tuple]], schema: str) -> DataFrame:
    """``make(columns, numbers)`` in tasks, each with all ``n`` rows of ``placed`` in the order of idx, masked where null, and numbers of its own of the ``replicates``."""
    tasks = max(1, min(replicates, placed.sparkSession.sparkContext.defaultParallelism, -(-(n + 20_000) * replicates // PER_TASK)))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches).combine_chunks()
        first, at = held.column("task")[0].as_py(), held.column("idx").to_numpy()
        data = {}
        for c in columns:
            value, ordered = held.column(c).chunk(0), np.ma.MaskedArray(np.empty(n), np.ma.nomask)
            ordered.data[at] = value.fill_null(0.0).to_numpy()
            if value.null_count:
                ordered.mask = np.zeros(n, bool)
                ordered.mask[at] = value.is_null().to_numpy(zero_copy_only=False)
            data[c] = ordered
        del held, at
        out = list(zip(*make(data, range(first, replicates, tasks)), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, [pa.int64()] + [pa.float64()] * (len(names) - 1), strict=True)], names=names)

    each = placed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "idx", *(F.col(c).cast("double").alias(c) for c in columns))
    return each.repartitionById(tasks, "task").mapInArrow(run, schema)


def _summed(seed: int) -> Callable[[dict[str, np.ma.MaskedArray], Sequence[int]], Iterator[tuple]]:
    """The sums over the units that each replicate draws; null where all of them are."""

    def make(data: dict[str, np.ma.MaskedArray], numbers: Sequence[int]) -> Iterator[tuple]:
        values = np.stack([v.data for v in data.values()], axis=1)
        there = {i: (~v.mask).astype(float) for i, v in enumerate(data.values()) if v.mask is not np.ma.nomask}
        odd, digests = not np.isfinite(values).all(), Digests(len(values))
        for rep in numbers:
            times = np.bincount(digests.drawn(f"{seed}-{rep}-", len(values)), minlength=len(values)).astype(float)
            total = (times[times > 0] @ values[times > 0] if odd else times @ values).tolist()
            yield rep, *(None if i in there and not times @ there[i] else v for i, v in enumerate(total))

    return make


def _mean(x: np.ndarray) -> float:
    """The mean; of a few values to the last digit, as equal errors in another order must tie."""
    return (math.fsum(x) if len(x) <= 4096 and np.isfinite(x).all() else float(x.sum())) / len(x)


def _shuffled(seed: int) -> Callable[[dict[str, np.ma.MaskedArray], Sequence[int]], Iterator[tuple]]:
    """mae and rmse of each permutation, after those of the rows as they are, as replicate -1, in the task of the first; pairs with a null don't count."""

    def make(data: dict[str, np.ma.MaskedArray], numbers: Sequence[int]) -> Iterator[tuple]:
        y, p = data["y"], data["p"]
        nulls, digests = not (y.mask is np.ma.nomask and p.mask is np.ma.nomask), Digests(len(y))
        for rep in [-1] * (numbers[0] == 0) + list(numbers):
            to = slice(None) if rep < 0 else digests.order(f"{seed}-{rep}-")
            e = p.data[to] - y.data
            if nulls:
                e = e[~(np.ma.getmaskarray(p)[to] | np.ma.getmaskarray(y))]
            yield (rep, _mean(np.abs(e)), math.sqrt(_mean(e * e))) if len(e) else (rep, None, None)

    return make


def sums(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Sufficient statistics of error metrics for each unit."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    e = b - a
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("sy"), F.sum(b).alias("sp"), F.sum(a * a).alias("syy"), F.sum(b * b).alias("spp"), F.sum(a * b).alias("syp"), F.sum(F.abs(e)).alias("sa"), F.sum(e * e).alias("se"), F.sum(e).alias("s1"))


SUMS = ("n", "sy", "sp", "syy", "spp", "syp", "sa", "se", "s1")


def metrics_of_sums() -> dict[str, Column]:
    n = F.col("n")
    vy, vp, c = F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("spp") - F.col("sp") * F.col("sp") / n, F.col("syp") - F.col("sy") * F.col("sp") / n
    tiny = 1e-12
    sd = F.sqrt(F.greatest(F.try_divide(F.col("se") - F.col("s1") * F.col("s1") / n, n - 1), F.lit(0.0)))
    bias = F.col("s1") / n
    return {
        "mae": F.col("sa") / n,
        "rmse": F.sqrt(F.col("se") / n),
        "r2": F.when(vy > tiny * F.col("syy"), 1 - F.col("se") / vy),
        "pearson_r": F.when((vy > tiny * F.col("syy")) & (vp > tiny * F.col("spp")), c / F.sqrt(vy * vp)),
        "bias": bias,
        "loa_low": bias - 1.96 * sd,
        "loa_high": bias + 1.96 * sd,
    }


def bootstrap(units: DataFrame, keys: Sequence[str], metrics: Sequence[str], replicates: int = 2000, confidence: float = 0.95, seed: int = 42, drop_undefined: bool = True) -> DataFrame:
    """metric, estimate, lower, upper, n_units and n_bootstrap, from one set of draws for all metrics.

    ``units`` holds the SUMS of each unit, keyed by unique ``keys``. With ``drop_undefined`` false one undefined replicate makes its metric's interval null.
    """
    placed = written(indexed(units.select(*keys, *SUMS), keys), "units")
    n_units = placed.count()
    if n_units < 2:
        raise ValueError("at least two units are required")
    total = placed.agg(*(F.sum(c).alias(c) for c in SUMS)).select(*(m.alias(k) for k, m in metrics_of_sums().items() if k in metrics))
    if n_units <= MOST_UNITS:
        made = whole_replicates(placed, n_units, SUMS, replicates, _summed(seed), ", ".join(["rep long", *(f"{c} double" for c in SUMS)]))
    else:
        made = draws(units.sparkSession, n_units, replicates, seed).join(placed, "idx").groupBy("rep").agg(*(F.sum(c).alias(c) for c in SUMS))
    reps = made.select("rep", *(m.alias(k) for k, m in metrics_of_sums().items() if k in metrics))
    tail = (1 - confidence) / 2
    long = lambda df, *keep: df.select(*keep, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("x")).select(*keep, "x.metric", "x.v")
    spread = long(reps, "rep").groupBy("metric").agg(F.expr(f"percentile(v, array({tail!r}, {1 - tail!r}))").alias("q"), F.count("v").alias("defined"))
    enough = F.col("defined") >= (max(10, replicates // 2) if drop_undefined else replicates)
    out = long(total).join(spread, "metric")
    return out.select("metric", F.col("v").alias("estimate"), F.when(enough, F.col("q")[0]).alias("lower"), F.when(enough, F.col("q")[1]).alias("upper"), F.lit(n_units).alias("n_units"), F.lit(replicates).alias("n_bootstrap"), F.lit(confidence).alias("confidence"))


def row_bootstrap(df: DataFrame, y: str, p: str, row_id: Sequence[str], metrics: Sequence[str] = ("mae",), **how) -> DataFrame:
    return bootstrap(sums(df, y, p, row_id), row_id, metrics, **how)


def cluster_bootstrap(df: DataFrame, y: str, p: str, cluster: str, metrics: Sequence[str] = ("mae", "rmse", "r2", "pearson_r"), **how) -> DataFrame:
    """Clusters are drawn whole, with all their rows."""
    return bootstrap(sums(df, y, p, [cluster]), [cluster], metrics, drop_undefined=False, **how)


def agreement_bootstrap(pairs: DataFrame, **how) -> DataFrame:
    """Intervals of bias, mae, rmse and limits of agreement over subjects; ``pairs`` has subject, r and m."""
    return bootstrap(sums(pairs, "r", "m", ["subject"]), ["subject"], ("bias", "mae", "rmse", "loa_low", "loa_high"), **how)


SLOPES = ("deming_slope", "deming_intercept", "passing_bablok_slope", "passing_bablok_intercept")
ATTEMPTS = 5


def slope_bootstrap(pairs: DataFrame, replicates: int = 2000, seed: int = 42, variance_ratio: float = 1.0, most_units: int | None = None) -> DataFrame:
    """Intervals of Deming and median-of-slopes coefficients over subjects.

    A median of slopes has no sufficient statistics: each replicate's subjects meet in one task, whose memory is linear in
    their number, as slopes are counted and not built. Replicates without a slope are replaced by the next ones, up to ATTEMPTS times as many as
    asked for; too few that have one fail. More than ``most_units`` subjects fail only where a caller sets it.
    """
    placed = written(indexed(pairs.select("subject", "r", "m"), ["subject"]), "units")
    n = placed.count()
    if n < 3:
        raise ValueError("at least 3 subjects are required")
    if most_units is not None and n > most_units:
        raise ValueError(f"at most {most_units} subjects are allowed")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        times = pdf["times"].to_numpy()
        x, y = np.repeat(pdf["r"].to_numpy(), times), np.repeat(pdf["m"].to_numpy(), times)
        slope = median_slope(pdf["r"].to_numpy(), pdf["m"].to_numpy(), times)
        sxx, syy, sxy = x.var(ddof=1), y.var(ddof=1), np.cov(x, y)[0, 1]
        if sxx == 0 or sxy == 0 or np.isnan(slope):
            return pd.DataFrame({"rep": [], **{c: [] for c in SLOPES}}).astype({"rep": "int64"})
        d = syy - variance_ratio * sxx
        deming = (d + np.sqrt(d * d + 4 * variance_ratio * sxy * sxy)) / (2 * sxy)
        return pd.DataFrame({"rep": [int(pdf["rep"].iloc[0])], "deming_slope": [deming], "deming_intercept": [y.mean() - deming * x.mean()], "passing_bablok_slope": [slope], "passing_bablok_intercept": [float(np.median(y - slope * x))]})

    schema = "rep long, " + ", ".join(f"{c} double" for c in SLOPES)
    parts, have, asked = [], 0, 0
    while have < replicates and asked < ATTEMPTS * replicates:
        more = min(max(replicates - have, 1), ATTEMPTS * replicates - asked)
        taken = draws(pairs.sparkSession, n, more, seed, asked).groupBy("rep", "idx").agg(F.count("*").alias("times"))
        parts.append(written(taken.join(placed, "idx").groupBy("rep").applyInPandas(fit, schema), "slopes"))
        have, asked = have + parts[-1].count(), asked + more
    if have < replicates:
        raise ValueError("too few replicates have a slope")
    long = reduce(DataFrame.union, parts).select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in SLOPES))).alias("x")).select("x.metric", "x.v")
    return long.groupBy("metric").agg(F.expr("percentile(v, array(0.025, 0.975))").alias("q"), F.count("v").alias("n_defined")).select("metric", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "n_defined")


def method_comparison(df: DataFrame, reference: str = "reference_value", measurement: str = "measurement_value", subject: str = "patient_id", variance_ratio: float = 1.0, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Deming and median-of-slopes regression of subject means, each coefficient with its bootstrap interval."""
    pairs = written(paired(df, reference, measurement, subject), "pairs")
    points = compared(pairs, variance_ratio)
    wide = slope_bootstrap(pairs, replicates, seed, variance_ratio).groupBy().agg(*(F.max(F.when(F.col("metric") == c, F.col(end))).alias(f"{c}_ci_{name}") for c in SLOPES for end, name in (("lower", "low"), ("upper", "high"))))
    return beside(points, wide)


PER_RANGE = 100_000


def _shuffled_in_ranges(placed: DataFrame, n: int, metrics: Sequence[str], permutations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The observed errors and those of each permutation, in which rows are ranked within ranges of their hash."""
    ranges = -(-n // PER_RANGE)
    reps = spread(placed.select("idx", "p")).select("idx", "p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("rep"))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("rep").cast("string"), F.col("idx").cast("string")).cast("binary"))
    reps, groups = reps.withColumn("key", key), ["rep"]
    if ranges > 1:
        reps, groups = reps.withColumn("part", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges, 32)), ["rep", "part"]
    within = F.row_number().over(W.partitionBy(*groups).orderBy("key", "idx")) - 1
    ranked = reps.select(*groups, "p", within.cast("long").alias("idx"))
    if ranges > 1:
        held = reps.groupBy("rep", "part").agg(F.count("*").alias("held"))
        starts = held.select("rep", "part", F.coalesce(F.sum("held").over(W.partitionBy("rep").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        ranked = ranked.join(starts, ["rep", "part"]).select("rep", "p", (F.col("idx") + F.col("start")).alias("idx"))
    e = F.col("p") - F.col("y")
    value = {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e))}
    observed = placed.agg(*(value[m].alias(f"observed_{m}") for m in metrics))
    null = ranked.join(placed.select("idx", "y"), "idx").groupBy("rep").agg(*(value[m].alias(m) for m in metrics))
    return observed, null


def permutation_tests(df: DataFrame, y: str, p: str, row_id: str, metrics: Sequence[str] = ("mae", "rmse"), permutations: int = 2000, seed: int = 42) -> DataFrame:
    """The error against that of predictions shuffled among rows; the null hypothesis is an error as small by chance. All metrics from one set of permutations.

    In each permutation predictions are ranked by a hash of replicate and row, and the k-th goes to the k-th row. Beyond MOST_ROWS ranks
    are counted within ranges of the hash of about PER_RANGE rows, so that no task holds all rows of a permutation.
    """
    placed = written(indexed(df.select(F.col(row_id).alias("row_id"), F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")), ["row_id"]), "rows")
    n = placed.count()
    if n < 2:
        raise ValueError("at least two rows are required")
    if n <= MOST_ROWS:
        made = written(whole_replicates(placed, n, ("y", "p"), permutations, _shuffled(seed), "rep long, mae double, rmse double"), "permutations")
        observed, null = made.where("rep < 0").select(*(F.col(m).alias(f"observed_{m}") for m in metrics)), made.where("rep >= 0")
    else:
        observed, null = _shuffled_in_ranges(placed, n, metrics, permutations, seed)
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"observed_{m}").alias("observed"), F.col(m).alias("v")) for m in metrics))
    long = beside(null, observed).select(F.explode(each).alias("x")).select("x.*")
    out = long.groupBy("metric", "observed").agg(F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("null_std"), ((1 + F.count_if(F.col("v") <= F.col("observed"))) / F.lit(permutations + 1.0)).alias("p_value"))
    return out.select("*", F.lit(permutations).alias("n_permutations"), F.lit(n).alias("n"))


def permutation_test(df: DataFrame, y: str, p: str, row_id: str, metric: str = "mae", permutations: int = 2000, seed: int = 42) -> DataFrame:
    return permutation_tests(df, y, p, row_id, (metric,), permutations, seed)


def coverage_bootstrap(df: DataFrame, y: str, lower: str, upper: str, subject: str, replicates: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Interval of the share of covered rows over subjects."""
    units = df.groupBy(F.col(subject).alias("subject")).agg(F.count("*").alias("n"), F.sum(F.col(y).between(F.col(lower), F.col(upper)).cast("long")).alias("hit"))
    placed = written(indexed(units, ["subject"]), "units")
    n_units = placed.count()
    if n_units < 2:
        raise ValueError("at least two subjects are required")
    reps = draws(df.sparkSession, n_units, replicates, seed).join(placed, "idx").groupBy("rep").agg((F.sum("hit") / F.sum("n")).alias("v"))
    tail = (1 - confidence) / 2
    q = reps.agg(F.expr(f"percentile(v, array({tail!r}, {1 - tail!r}))").alias("q"))
    total = placed.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_subjects"), (F.sum("hit") / F.sum("n")).alias("observed_coverage"))
    return beside(total, q).select("n_rows", "n_subjects", "observed_coverage", F.col("q")[0].alias("coverage_ci_low"), F.col("q")[1].alias("coverage_ci_high"))


def interval_calibration(df: DataFrame, y: str, lower: str, upper: str, alpha: float, subject: str, **how) -> DataFrame:
    """Nominal against observed coverage of intervals, with widths and a subject bootstrap of the coverage."""
    width = F.col(upper) - F.col(lower)
    widths = df.agg(F.avg(width).alias("mean_width"), F.lit(median(df, width)).alias("median_width"))
    c = beside(coverage_bootstrap(df, y, lower, upper, subject, **how), widths)
    return c.withColumns({"nominal_coverage": F.lit(1 - alpha), "coverage_error": F.col("observed_coverage") - F.lit(1 - alpha), "miss_rate": 1 - F.col("observed_coverage")})


def conformal_rank(n: int, alpha: float) -> int:
    """Which score, from 1, bounds a new one with probability 1 - alpha."""
    return int(min(n, max(1, np.ceil((n + 1) * (1 - alpha)))))


def split_conformal(df: DataFrame, y: str, p: str, alpha: float = 0.10) -> DataFrame:
    """One row: quantile (the k-th smallest absolute residual, without interpolation), alpha, n and the calibration rmse."""
    scores = df.select((F.col(p) - F.col(y)).cast("double").alias("e")).withColumn("score", F.abs("e"))
    n = scores.where("score is not null").count()
    if not n or not 0 < alpha < 1:
        raise ValueError("calibration needs rows and an alpha between 0 and 1")
    q = order_statistics(scores, "score", [conformal_rank(n, alpha) - 1])[0]
    return scores.agg(F.lit(q).alias("quantile"), F.lit(alpha).alias("alpha"), F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("calibration_rmse"))


def predict_interval(df: DataFrame, p: str, model: DataFrame) -> DataFrame:
    """Bounds around ``p``; ``model`` is one row."""
    return beside(df, model.select("quantile")).withColumns({"lower": F.col(p) - F.col("quantile"), "upper": F.col(p) + F.col("quantile")}).drop("quantile")


