"""Agreement, robustness and regression reports of paired measurements.

Repeats of a subject are averaged before any statistic (``paired``). Reports are one row, or one row a group.
Null, NaN or infinite values, missing subjects and frames that are too small make the query fail; what can't be
computed (a spread of one pair, a correlation with a constant) is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import as_col, beside, finite, guarded, pearson, ratio
from ..functions.ordering import indexed, quantiles, running_total
from ..functions.slopes import median_slope
from ..plans.staging import written

Z = 1.96


def paired(df: DataFrame, reference: str = "reference_value", measurement: str = "measurement_value", subject: str = "patient_id", by: Sequence[str] = ()) -> DataFrame:
    """subject (and ``by``), r and m: means of each subject; n_rows, and n_bad, its values that aren't finite."""
    bad = ~(finite(reference) & finite(measurement))
    return df.groupBy(*by, F.col(subject).alias("subject")).agg(
        F.avg(F.col(reference).cast("double")).alias("r"), F.avg(F.col(measurement).cast("double")).alias("m"), F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad")
    )


def _rules(least: int) -> dict[str, Column]:
    return {"values must be finite numbers": F.sum("n_bad") > 0, "subject identifiers must be present": F.count_if(F.col("subject").isNull()) > 0, f"at least {least} paired subjects are required": F.count("*") < least}


def _limits(e: Column, name: str = "loa") -> list[Column]:
    return [(F.avg(e) - Z * F.stddev_samp(e)).alias(f"{name}_low"), (F.avg(e) + Z * F.stddev_samp(e)).alias(f"{name}_high")]


def error_metrics(y: Column | str, p: Column | str) -> list[Column]:
    """n, mae, rmse, r2, pearson_r and the Bland-Altman bias, limits and mean, as aggregates."""
    y, p = as_col(y), as_col(p)
    e = p - y
    low, high = _limits(e)
    return [
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.count("*") * F.var_pop(y))).alias("r2"), pearson(y, p).alias("pearson_r"),
        F.avg(e).alias("bland_altman_bias"), low.alias("bland_altman_lower"), high.alias("bland_altman_upper"), F.avg((y + p) / 2).alias("mean_reference"),
    ]


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), model: str | None = None) -> DataFrame:
    """Error metrics over all rows or of each group; a null group is a group."""
    out = df.groupBy(*by).agg(*error_metrics(y, p), F.count_if(~(finite(y) & finite(p))).alias("_bad"))
    out = out.withColumn("n", guarded(F.col("n"), {"values must be finite numbers": F.col("_bad") > 0, "values must not be empty": F.col("n") == 0}).cast("long")).drop("_bad")
    return out.withColumn("model", F.lit(model)) if model else out


def bland_altman(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    low, high = _limits(e)
    out = df.agg(F.count("*").alias("n"), F.avg(e).alias("bias"), low, high, F.count_if(~(finite(y) & finite(p))).alias("_bad"))
    return out.withColumn("bias", guarded(F.col("bias"), {"values must be finite numbers": F.col("_bad") > 0, "at least two pairs are required": F.col("n") < 2})).drop("_bad")


def coverage_under_uncertainty(df: DataFrame, y: str, p: str, u: str, z: float = Z) -> DataFrame:
    inside = F.abs(F.col(y) - F.col(p)) <= z * F.col(u)
    out = df.agg(F.avg(inside.cast("double")).alias("coverage"), F.count_if(F.col(u) < 0).alias("_bad"), F.count_if(~(finite(y) & finite(p) & finite(u))).alias("_odd"))
    return out.select(guarded(F.col("coverage"), {"values must be finite numbers": F.col("_odd") > 0, "uncertainty must not be negative": F.col("_bad") > 0}).alias("coverage"))


def grouped_regression(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """n, mae, rmse and bias of each group; a null group fails."""
    e = F.col(p) - F.col(y)
    out = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    return out.withColumn("bias", guarded(F.col("bias"), {"groups must be present": F.col("group").isNull()}))


def uncertainty_interval(df: DataFrame, p: str, u: str, z: float = Z) -> DataFrame:
    return df.withColumns({"lower": F.col(p) - z * F.col(u), "upper": F.col(p) + z * F.col(u)})


def subgroup_metrics(df: DataFrame, y: str, p: str, group: str, min_n: int = 10) -> DataFrame:
    """Error metrics of groups of at least ``min_n`` rows, the null group included."""
    return regression_metrics(df.withColumn("group", F.col(group)), y, p, ["group"]).where(F.col("n") >= min_n).orderBy(F.col("group").cast("string"))


def measurement_agreement(df: DataFrame, reference: str = "reference_value", measurement: str = "measurement_value", subject: str = "patient_id") -> DataFrame:
    e = F.col("m") - F.col("r")
    low, high = _limits(e)
    out = paired(df, reference, measurement, subject).agg(
        guarded(F.sum("n_rows"), _rules(1) | {"mean reference must not be zero": F.avg("r") == 0}).cast("long").alias("n_rows"),
        F.count("*").alias("n_pairs"), F.avg("r").alias("mean_reference"), F.avg("m").alias("mean_measurement"), F.avg(e).alias("mean_bias"), (100 * F.try_divide(F.avg(e), F.abs(F.avg("r")))).alias("relative_bias_percent"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_samp(e).alias("error_sd"), low, high, F.coalesce(F.var_samp(e), F.lit(0.0)).alias("_var"),
    )
    square = F.col("mean_bias") * F.col("mean_bias")
    return out.withColumn("systematic_error_fraction_percent", F.coalesce(100 * F.try_divide(square, square + F.col("_var")), F.lit(0.0))).drop("_var")


def one_group_each(pairs: DataFrame, group: str) -> DataFrame:
    """Fails where a subject is in more than one group; else the pairs as they are."""
    many = F.count(F.lit(1)).over(W.partitionBy("subject"))
    return pairs.withColumn("m", guarded(F.col("m"), {"a subject must belong to one subgroup": many > 1}))


def subgroup_robustness(df: DataFrame, subgroup: str = "device_model", reference: str = "reference_value", measurement: str = "measurement_value", subject: str = "patient_id", least: int = 2) -> DataFrame:
    """One row a subgroup with the overall mae and rmse beside it; the relative bias keeps the sign of the mean reference.

    Calibration transfer is the same report of already calibrated values.
    """
    pairs = one_group_each(paired(df, reference, measurement, subject, [subgroup]), subgroup)
    e = F.col("m") - F.col("r")
    groups = pairs.groupBy(F.col(subgroup).alias("subgroup")).agg(
        F.count("*").alias("n_pairs"), F.avg("r").alias("mean_reference"), F.avg("m").alias("mean_measurement"), F.avg(e).alias("mean_bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.try_divide(F.avg(e), F.avg("r"))).alias("relative_bias_percent"), F.sum(F.abs(e)).alias("_abs"), F.sum(e * e).alias("_square"), F.sum("n_bad").alias("_bad"), F.count_if(F.col("subject").isNull()).alias("_null"),
    )
    total = groups.agg(*(F.sum(c).alias(f"_all{c}") for c in ("n_pairs", "_abs", "_square")))
    groups = beside(groups, total)
    rules = {
        "values must be finite numbers": F.col("_bad") > 0,
        "identifiers must be present": (F.col("_null") > 0) | F.col("subgroup").isNull(),
        f"each subgroup needs {least} paired subjects": F.col("n_pairs") < least,
        "at least three paired subjects are required": F.col("_alln_pairs") < 3,
    }
    n = F.col("_alln_pairs")
    out = groups.withColumns({"overall_mae": F.col("_all_abs") / n, "overall_rmse": F.sqrt(F.col("_all_square") / n), "mean_bias": guarded(F.col("mean_bias"), rules)})
    return out.drop("_abs", "_square", "_bad", "_null", *total.columns)


def acquisition_perturbation(df: DataFrame, reference_condition: str, value: str = "measurement_value", subject: str = "patient_id", factor: str = "perturbation") -> DataFrame:
    """For each other condition, its subjects' means against their own under the reference condition."""
    means = df.groupBy(F.col(subject).alias("subject"), F.col(factor).alias("condition")).agg(guarded(F.avg(F.col(value).cast("double")), {"values must be finite numbers": F.count_if(~finite(value)) > 0}).alias("v"))
    base = means.where(F.col("condition") == reference_condition).select("subject", F.col("v").alias("r"))
    e = F.col("v") - F.col("r")
    low, high = _limits(e)
    pairs = means.where(F.col("condition") != reference_condition).join(base, "subject")
    return pairs.groupBy("condition").agg(F.count("*").alias("n_pairs"), F.avg(e).alias("mean_bias"), F.stddev_samp(e).alias("sd_bias"), (100 * F.try_divide(F.avg(e), F.abs(F.avg("r")))).alias("relative_bias_percent"), low, high).orderBy("condition")


def repeatability(df: DataFrame, value: str = "measurement_value", subject: str = "patient_id", device: str = "device_model") -> DataFrame:
    """Within-subject spread of repeats and, where there are exactly two devices, their mean difference."""
    v = F.col(value).cast("double")
    each = df.groupBy(F.col(subject).alias("subject"), F.col(device).alias("device")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.avg(v).alias("mean"), F.count_if(~finite(value)).alias("bad"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    subjects = df.groupBy(F.col(subject).alias("subject")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count_if(~finite(value) | F.col(device).isNull()).alias("bad"))
    more = F.col("n") >= 2
    within = subjects.agg(
        guarded(F.sum("n"), {"values must be finite numbers": F.sum("bad") > 0, "identifiers must be present": F.count_if(F.col("subject").isNull()) > 0}).cast("long").alias("n_rows"),
        F.count("*").alias("n_subjects"), F.count_if(more).alias("n_repeated_subjects"), F.sqrt(F.avg(F.when(more, F.col("sd") * F.col("sd")))).alias("within_subject_sd"),
        F.avg(F.when(more & (F.col("mean") != 0), 100 * F.col("sd") / F.abs("mean"))).alias("mean_within_subject_cv_percent"),
    ).withColumn("repeatability_coefficient", 2.77 * F.col("within_subject_sd"))
    names = each.agg(F.count_distinct("device").alias("n_devices"), F.min("device").alias("d0"), F.max("device").alias("d1"))
    sides = beside(each, names).where("device = d0 or device = d1").groupBy("subject").agg(
        F.max(F.when(F.col("device") == F.col("d0"), F.col("mean"))).alias("a"), F.max(F.when(F.col("device") == F.col("d1"), F.col("mean"))).alias("b")
    )
    d = F.col("b") - F.col("a")
    low, high = _limits(d)
    between = sides.where("a is not null and b is not null").agg(F.count("*").alias("_k"), F.avg(d).alias("between_device_mean_bias"), F.stddev_samp(d).alias("between_device_sd"), low.alias("between_device_loa_low"), high.alias("between_device_loa_high"))
    one = beside(beside(within, names.select("n_devices")), between)
    two = (F.col("n_devices") == 2) & (F.col("_k") >= 2)
    return one.select(*within.columns, "n_devices", *(F.when(two, F.col(c)).alias(c) for c in between.columns if c != "_k"))


def temporal_stability(df: DataFrame, value: str = "measurement_value", session: str = "session_id") -> DataFrame:
    """Drift of session means against the first session."""
    s = df.groupBy(F.col(session).alias("session")).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count("*").alias("n"), F.count_if(~finite(value)).alias("bad"))
    s = written(indexed(s.withColumn("_last", F.col("session").isNull()), ["_last", "session"], "x"), "sessions")
    s = beside(s, s.agg(F.min_by("mean", "x").alias("base")))
    rules = {"values must be finite numbers": F.sum("bad") > 0, "sessions must be present": F.count_if(F.col("session").isNull()) > 0, "at least two sessions are required": F.count("*") < 2, "the first session's mean must not be zero": F.first("base") == 0}
    return s.agg(
        guarded(F.sum("n"), rules).cast("long").alias("n_rows"), F.count("*").alias("n_sessions"), F.first("base").alias("baseline_mean"), (100 * F.try_divide(F.stddev_samp("mean"), F.abs(F.avg("mean")))).alias("session_mean_cv_percent"),
        F.max(F.abs(100 * F.try_divide(F.col("mean") - F.col("base"), F.abs("base")))).alias("max_abs_relative_drift_percent"), F.regr_slope("mean", "x").alias("linear_drift_per_session"),
    )


def stacked_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with rank_<column> for each of ``columns``, from 1, ties sharing their mean rank, null for null.

    Counts of the distinct values of all columns are stacked in one table, summed up in ranges by one sort, and joined back.
    """
    each = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))
    counts = df.select(F.explode(each).alias("x")).select("x.*").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    below = running_total(counts, ["c", "v"], "n", "below")
    first = {r["c"]: r["k"] for r in below.groupBy("c").agg(F.min("below").alias("k")).collect()}
    out = df
    for c in columns:
        rank = (F.col("below") - F.lit(first.get(c, 0)) + (F.col("n") + 1) / 2).alias(f"rank_{c}")
        out = out.join(below.where(F.col("c") == c).select(F.col("v").alias("_v"), rank), F.col(c).cast("double") == F.col("_v"), "left").drop("_v")
    return out


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """The rank correlation; null for fewer than three rows or a constant."""
    ranked = stacked_ranks(df.select(F.col(x).alias("x"), F.col(y).alias("y")), ("x", "y"))
    return ranked.agg(F.when(F.count("*") >= 3, pearson("rank_x", "rank_y")).alias("spearman"))


def residual_strata(pairs: DataFrame, n_bins: int = 4) -> DataFrame:
    """Bins of the reference at its quantiles, right-closed with the lowest included; repeated edges merge and empty bins are left out."""
    edges = sorted(set(quantiles(pairs, "r", [i / n_bins for i in range(n_bins + 1)])))
    if len(edges) < 3:
        raise ValueError("the reference doesn't vary enough for strata")
    res = F.col("m") - F.col("r")
    stratum = sum(((F.col("r") > x).cast("int") for x in edges[1:-1]), F.lit(0))
    return pairs.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"), F.avg("r").alias("reference_mean"), F.avg(res).alias("residual_mean"), F.stddev_samp(res).alias("residual_sd"), F.avg(F.abs(res)).alias("mae"))


def residual_diagnostics(df: DataFrame, reference: str = "reference_value", measurement: str = "measurement_value", subject: str = "patient_id") -> DataFrame:
    """Residual level, spread and dependence on the reference."""
    pairs = written(paired(df, reference, measurement, subject), "pairs").withColumn("res", F.col("m") - F.col("r")).withColumn("abs", F.abs("res"))
    ranked = stacked_ranks(pairs, ("r", "res", "abs", "m"))
    return ranked.agg(
        guarded(F.sum("n_rows"), _rules(3) | {"a reference of zero has no relative error": F.count_if(F.col("r") == 0) > 0}).cast("long").alias("n_rows"), F.count("*").alias("n_pairs"), F.avg("r").alias("mean_reference"), F.avg("m").alias("mean_measurement"),
        F.avg("res").alias("mean_residual"), F.stddev_samp("res").alias("residual_sd"), F.avg("abs").alias("mae"), F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rmse"), (100 * F.avg(F.try_divide(F.col("abs"), F.abs("r")))).alias("mean_absolute_relative_error_percent"),
        pearson("rank_r", "rank_res").alias("spearman_reference_residual"), pearson("rank_r", "rank_abs").alias("spearman_reference_absolute_residual"), pearson("rank_r", "rank_m").alias("spearman_reference_measurement"), F.regr_slope("abs", "r").alias("absolute_residual_slope"),
    )


def deming(x: Column | str, y: Column | str, variance_ratio: float = 1.0) -> list[Column]:
    """Slope and intercept of Deming regression as aggregates; a constant side or no covariance fails."""
    sxx, syy, sxy = F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)
    d = syy - variance_ratio * sxx
    slope = F.try_divide(d + F.sqrt(d * d + 4 * variance_ratio * sxy * sxy), 2 * sxy)
    rules = {"Deming regression is undefined": F.coalesce((sxx == 0) | (sxy == 0), F.lit(True))}
    return [guarded(slope, rules).alias("deming_slope"), (F.avg(y) - slope * F.avg(x)).alias("deming_intercept")]


BLOCK = 2048


def _slopes(blocks: pd.DataFrame) -> np.ndarray:
    """Angles of the slopes between the points of two blocks, or within one."""
    ids = sorted(blocks["block"])
    a, b = blocks[blocks["block"] == ids[0]].iloc[0], blocks[blocks["block"] == ids[-1]].iloc[0]
    dx = np.asarray(b["x"])[None, :] - np.asarray(a["x"])[:, None]
    dy = np.asarray(b["y"])[None, :] - np.asarray(a["y"])[:, None]
    use = dx != 0
    if len(ids) == 1:
        use &= np.triu(np.ones_like(use), 1).astype(bool)
    return dy[use] / dx[use]


#: Points that one task may hold: about 100 bytes each.
ONE_TASK = 2_000_000


def slope_median(pairs: DataFrame) -> float:
    """The median slope of all pairs of points (Theil-Sen): in n log n in one task up to ONE_TASK points, else counted by blocks."""
    points = pairs.where("r is not null and m is not null").select("subject", "r", "m")
    if points.limit(ONE_TASK + 1).count() > ONE_TASK:
        return pairwise_slope_median(points)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slope": [median_slope(pdf["r"].to_numpy(), pdf["m"].to_numpy(), np.ones(len(pdf), np.int64))]})

    slope = points.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "slope double").first()
    if slope is None or np.isnan(slope[0]):
        raise ValueError("no two points differ in x")
    return float(slope[0])


def pairwise_slope_median(pairs: DataFrame, width: int = 16384, few: int = 200_000) -> float:
    """The median slope of all pairs of points (Theil-Sen), without emitting the pairs and without all points in one task.

    Points are put into blocks and each two blocks meet in one task, which counts its slopes by angle. Only the step of
    angles that holds the median is counted again, finer, until few slopes are left in it; those are ranked exactly.
    The driver gets at most ``width`` counts a pass and ``few`` slopes at the end.
    """
    n = pairs.count()
    blocks_n = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("subject"), F.lit(blocks_n)).alias("block")
    blocks = written(pairs.where("r is not null and m is not null").groupBy(block).agg(F.collect_list("r").alias("x"), F.collect_list("m").alias("y")), "blocks")
    meet = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks_n - 1)))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).groupBy("i", "j")

    def counted(low: float, high: float) -> dict[int, int]:
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            s = np.arctan(_slopes(pdf))
            s = s[(s >= low) & (s <= high)]
            part, k = np.unique(np.minimum((s - low) / (high - low) * width, width - 1).astype(np.int64), return_counts=True)
            return pd.DataFrame({"part": part, "n": k})

        return {r["part"]: r["n"] for r in meet.applyInPandas(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()}

    def ranked(rank: int, low: float, high: float, counts: dict[int, int]) -> float:
        while True:
            for part in sorted(counts):
                if rank < counts[part]:
                    break
                rank -= counts[part]
            step = (high - low) / width
            a, b = low + part * step, low + (part + 1) * step
            if counts[part] <= few or not low < a < b < high:
                break
            low, high = a, b
            counts = counted(low, high)
        held = counts[part]

        def take(pdf: pd.DataFrame) -> pd.DataFrame:
            s = _slopes(pdf)
            t = np.arctan(s)
            inside = (t >= low) & (t <= high)
            mine = np.minimum((t - low) / (high - low) * width, width - 1).astype(np.int64) == part
            v, k = np.unique(s[inside & mine], return_counts=True)
            return pd.DataFrame({"s": v, "n": k})

        rows = meet.applyInPandas(take, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").collect()
        assert sum(r["n"] for r in rows) == held
        for r in rows:
            if rank < r["n"]:
                return r["s"]
            rank -= r["n"]
        raise ValueError("rank out of range")

    low, high = -np.pi / 2, np.pi / 2
    counts = counted(low, high)
    total = sum(counts.values())
    if not total:
        raise ValueError("no two points differ in x")
    return float(np.mean([ranked(k, low, high, counts) for k in sorted({(total - 1) // 2, total // 2})]))


def compared(pairs: DataFrame, variance_ratio: float = 1.0) -> DataFrame:
    """Deming and median-of-slopes regression of subject means (see ``paired``)."""
    slope = slope_median(pairs)
    base = pairs.agg(guarded(F.sum("n_rows"), _rules(3)).cast("long").alias("n_rows"), F.count("*").alias("n_pairs"), F.avg("r").alias("mean_reference"), F.avg("m").alias("mean_measurement"), *deming("r", "m", variance_ratio), F.lit(median(pairs, F.col("m") - F.lit(slope) * F.col("r"))).alias("passing_bablok_intercept"))
    return base.withColumns({"passing_bablok_slope": F.lit(slope), "variance_ratio": F.lit(variance_ratio)})


def relative_mae_change(a: Column, b: Column) -> Column:
    """(b - a) / a; from zero it is NaN to zero and infinite otherwise; negative values fail."""
    change = F.when(a == 0, F.when(b == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(ratio(b - a, a))
    return guarded(change, {"errors must not be negative": (a < 0) | (b < 0)})


def device_robustness(source: DataFrame, held_out: DataFrame, key: str = "model", metrics: Sequence[str] = ("mae", "rmse")) -> DataFrame:
    """Metrics of each model on its source and on held-out devices, with their relative change, best first."""
    a = source.select(key, *(F.col(c).alias(f"{c}_source") for c in metrics))
    b = held_out.select(key, *(F.col(c).alias(f"{c}_held_out") for c in metrics))
    out = a.join(b, key)
    return out.withColumns({f"{c}_relative_change": relative_mae_change(F.col(f"{c}_source"), F.col(f"{c}_held_out")) for c in metrics}).orderBy("mae_held_out")


def median(df: DataFrame, value: Column) -> float | None:
    """The exact median of all rows, from counts; null without values."""
    return next(iter(quantiles(df.select(value.alias("v")), "v", [0.5])), None)


def interval_metrics(df: DataFrame, y: str, lower: str, upper: str) -> DataFrame:
    """Coverage of closed intervals, and their mean and median width."""
    width = F.col(upper) - F.col(lower)
    out = df.agg(F.count("*").alias("n"), F.avg(F.col(y).between(F.col(lower), F.col(upper)).cast("double")).alias("coverage"), F.avg(width).alias("mean_width"), F.lit(median(df, width)).alias("median_width"), F.count_if(width < 0).alias("_bad"))
    return out.withColumn("coverage", guarded(F.col("coverage"), {"lower bounds must not exceed upper bounds": F.col("_bad") > 0, "values must not be empty": F.col("n") == 0})).drop("_bad")


def abstained(df: DataFrame, lower: str, upper: str, max_width: float) -> DataFrame:
    return df.withColumn("abstain", F.col(upper) - F.col(lower) > max_width)
