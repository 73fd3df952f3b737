"""Optical features and quality of images as tables of pixels (image_id, y, x, r, g, b; codes 0 to 255).

Pixels group by image, so a large image set is spread over tasks by image; everything is built-in expressions.
Null channels make an image's features null or fail where said. Images without pixels have no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import guarded, linear_rgb

EPS = 1e-8
CHANNELS = ("r", "g", "b")


def linearized(df: DataFrame) -> DataFrame:
    """With lr, lg and lb, the linear values."""
    return df.withColumns({f"l{c}": linear_rgb(c) for c in CHANNELS})


def chromaticity(df: DataFrame) -> DataFrame:
    """With cr, cg and cb: each linear channel's share of their sum."""
    total = F.greatest(F.col("lr") + F.col("lg") + F.col("lb"), F.lit(EPS))
    return df.withColumns({f"c{c}": F.col(f"l{c}") / total for c in CHANNELS})


def saturated(low: int = 1, high: int = 254) -> Column:
    """Any channel at or beyond the usable codes."""
    return (F.least(*CHANNELS) <= low) | (F.greatest(*CHANNELS) >= high)


def cropped(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside the box (image_id, roi_x0, roi_y0, roi_x1, roi_y1) of their image; an image without a box has no region."""
    inside = (F.col("x") >= F.col("roi_x0")) & (F.col("x") < F.col("roi_x1")) & (F.col("y") >= F.col("roi_y0")) & (F.col("y") < F.col("roi_y1"))
    return df.join(boxes, "image_id").where(inside).drop("roi_x0", "roi_y0", "roi_x1", "roi_y1")


def gray(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """Integer luma with 16-bit weights (fixed values) and rounding."""
    c = [F.col(x) if isinstance(x, str) else x for x in (r, g, b)]
    return F.floor((19595 * c[0] + 38470 * c[1] + 7471 * c[2] + 32768) / 65536)


def valid_region(df: DataFrame, gains: Sequence[float] | None = None, calibration_id: str | None = None, least: float = 0.80, low: int = 1, high: int = 254) -> DataFrame:
    """Per image: pixels, valid and saturated fractions, channel means of the valid ones after gains, and PASS or FAIL.

    Valid codes are above ``low`` minus one and below ``high`` plus one. Gains need the id of their calibration. The means of a failed image are null.
    """
    if gains is not None and (not calibration_id or len(gains) != 3 or not all(np.isfinite(g) and g > 0 for g in gains)):
        raise ValueError("three positive gains and the id of their calibration are required")
    gains = gains or (1.0, 1.0, 1.0)
    codes_ok = F.least(*CHANNELS).between(0, 255) & F.greatest(*CHANNELS).between(0, 255)
    ok = (F.least(*CHANNELS) >= low) & (F.greatest(*CHANNELS) <= high)
    p = linearized(df)
    means = [F.avg(F.when(ok, F.greatest(F.col(f"l{c}") * g, F.lit(0.0)))).alias(f"mean_{c}") for c, g in zip(CHANNELS, gains, strict=True)]
    out = p.groupBy("image_id").agg(F.count("*").alias("pixels"), F.avg(ok.cast("double")).alias("valid_fraction"), F.avg((~ok).cast("double")).alias("saturated_fraction"), *means, F.count_if(~codes_ok).alias("_bad"))
    passed = F.col("valid_fraction") >= least
    out = out.withColumn("valid_fraction", guarded(F.col("valid_fraction"), {"pixel codes must lie between 0 and 255": F.col("_bad") > 0})).drop("_bad")
    return out.withColumns({"status": F.when(passed, "PASS").otherwise("FAIL"), **{f"mean_{c}": F.when(passed, F.col(f"mean_{c}")) for c in CHANNELS}})


def features(df: DataFrame, reference: Mapping[str, float] | None = None) -> DataFrame:
    """Per image: linear means, spreads and total, chromaticities, ratios and, against reference codes, relative optical densities."""
    p = chromaticity(linearized(df))
    ratio = lambda a, b: F.avg(f"l{a}") / F.greatest(F.abs(F.avg(f"l{b}")), F.lit(EPS))
    stats = [*(F.avg(f"l{c}").alias(f"linear_{c}_mean") for c in CHANNELS), F.avg(F.col("lr") + F.col("lg") + F.col("lb")).alias("linear_total_mean"), *(F.stddev_pop(f"l{c}").alias(f"linear_{c}_std") for c in CHANNELS)]
    stats += [*(F.avg(f"c{c}").alias(f"chrom_{c}_mean") for c in CHANNELS), ratio("r", "g").alias("r_over_g"), ratio("r", "b").alias("r_over_b"), ratio("g", "b").alias("g_over_b")]
    if reference:
        stats += [F.avg(relative_density(F.col(f"l{c}"), linear_rgb(F.lit(float(reference[c]))))).alias(f"relative_od_{c}_mean") for c in CHANNELS]
    return p.groupBy("image_id").agg(F.count("*").alias("pixels"), *stats)


def relative_density(sample: Column, reference: Column, eps: float = 1e-6) -> Column:
    """-ln(sample / reference) of linear values, which must be positive to mean anything."""
    return -F.log(F.greatest(sample, F.lit(eps)) / F.greatest(reference, F.lit(eps)))


def lit_minus_ambient(flash: DataFrame, ambient: DataFrame, gains: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Linear flash minus ambient light of the same pixel, times gains; negatives stay. Pixels without a partner are left out."""
    a = linearized(flash).select("image_id", "y", "x", *(F.col(f"l{c}").alias(f"f{c}") for c in CHANNELS))
    b = linearized(ambient).select("image_id", "y", "x", *(F.col(f"l{c}").alias(f"a{c}") for c in CHANNELS))
    return a.join(b, ["image_id", "y", "x"]).select("image_id", "y", "x", *(((F.col(f"f{c}") - F.col(f"a{c}")) * g).alias(f"d{c}") for c, g in zip(CHANNELS, gains, strict=True)))


def absorption(spectra: DataFrame, concentrations: DataFrame) -> DataFrame:
    """(sample_id, wavelength, absorption): sum of extinction (chromophore, wavelength, extinction) times concentration; negative ones fail."""
    c = concentrations.withColumn("concentration", guarded(F.col("concentration"), {"concentrations must not be negative": F.col("concentration") < 0}))
    return c.join(spectra, "chromophore").groupBy("sample_id", "wavelength").agg(F.sum(F.col("extinction") * F.col("concentration")).alias("absorption"))


def attenuation(absorbed: Column, scattered: Column, length: Column) -> Column:
    return F.exp(-(absorbed + scattered) * length)


def identifiability(matrix: Sequence[Sequence[float]], tolerance: float | None = None) -> dict:
    """Rank and condition of a small sensitivity matrix (one row a measurement, one column a parameter)."""
    a = np.asarray(matrix, float)
    rank, condition = int(np.linalg.matrix_rank(a, tol=tolerance)), float(np.linalg.cond(a))
    return {"rank": rank, "parameters": a.shape[1], "full_column_rank": rank == a.shape[1], "condition_number": condition, "ill_conditioned": not condition <= 1e3}


def sharpness(df: DataFrame) -> DataFrame:
    """Per image: gray mean and spread, variance of the Laplacian with mirrored borders, and shares of dark, bright and saturated pixels."""
    p = df.withColumn("v", gray())
    row, column = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    left, right, up, down = F.lag("v").over(row), F.lead("v").over(row), F.lag("v").over(column), F.lead("v").over(column)
    here = F.col("v")
    p = p.withColumn("laplacian", F.coalesce(left, right, here) + F.coalesce(right, left, here) + F.coalesce(up, down, here) + F.coalesce(down, up, here) - 4 * here)
    high, low = F.greatest(*CHANNELS), F.least(*CHANNELS)
    s = F.when(high > 0, F.round(255.0 * (high - low) / high)).otherwise(0)
    share = lambda c: F.avg(c.cast("double"))
    return p.groupBy("image_id").agg(
        F.avg("v").alias("gray_mean"), F.stddev_pop("v").alias("gray_std"), F.var_pop("laplacian").alias("laplacian_variance"), share(here <= 10).alias("dark_fraction"), share(here >= 245).alias("bright_fraction"), share(s >= 250).alias("saturated_fraction")
    )


def _block(position: Column, size: Column, grid: int = 10) -> Column:
    """Which of min(grid, size) blocks holds a position, when the first size % k blocks are one longer."""
    k = F.least(F.lit(grid), size)
    short = F.floor(size / k)
    extra = size - short * k
    return F.when(position < extra * (short + 1), F.floor(position / (short + 1))).otherwise(extra + F.floor((position - extra * (short + 1)) / short))


def illumination_cv(df: DataFrame, grid: int = 10) -> DataFrame:
    """(image_id, illum_cv): spread over mean of block means; infinite where the mean isn't positive."""
    sized = df.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    p = df.join(sized, "image_id").withColumn("v", gray())
    blocks = p.groupBy("image_id", _block(F.col("y"), F.col("h"), grid).alias("by"), _block(F.col("x"), F.col("w"), grid).alias("bx")).agg(F.avg("v").alias("v"))
    mean = F.avg("v")
    return blocks.groupBy("image_id").agg(F.when(mean > 0, F.try_divide(F.stddev_pop("v"), mean)).otherwise(F.lit(float("inf"))).alias("illum_cv"))


#: Engineering starting points (fixed values).
THRESHOLDS = {"low_sharpness": 1454.422186, "high_illum_cv": 0.350527, "high_saturation": 0.010814, "low_dynamic_range": 172.0}
GRID = 10


def assessed(df: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """Per image: levels, 1st and 99th percentiles, dynamic range, clipping, gray variance, evenness, size, five flags and PASS, REVIEW or FAIL."""
    t = THRESHOLDS | dict(thresholds)
    if unknown := set(t) - set(THRESHOLDS):
        raise ValueError(f"unknown thresholds: {sorted(unknown)}")
    codes = df.select("image_id", F.explode(F.array(*CHANNELS)).alias("c"))
    share = lambda c: F.avg(c.cast("double"))
    levels = codes.groupBy("image_id").agg(F.avg("c").alias("mean_intensity"), F.stddev_pop("c").alias("std_intensity"), F.expr("percentile(c, array(0.01, 0.99))").alias("q"), share(F.col("c") <= 5).alias("low_clip_ratio"), share(F.col("c") >= 250).alias("high_clip_ratio"))
    shape = df.groupBy("image_id").agg(F.var_pop(gray()).alias("sharpness"), (F.max("x") + 1).alias("image_width"), (F.max("y") + 1).alias("image_height"))
    one = levels.join(shape, "image_id").join(illumination_cv(df, GRID), "image_id")
    one = one.withColumns({"p01": F.col("q")[0], "p99": F.col("q")[1], "dynamic_range": F.col("q")[1] - F.col("q")[0], "saturation_ratio": F.col("low_clip_ratio") + F.col("high_clip_ratio")}).drop("q")
    flags = {
        "flag_insufficient_dimensions": F.least("image_width", "image_height") < GRID, "flag_low_sharpness": F.col("sharpness") < t["low_sharpness"], "flag_high_illum_cv": F.col("illum_cv") > t["high_illum_cv"],
        "flag_high_saturation": F.col("saturation_ratio") > t["high_saturation"], "flag_low_dynamic_range": F.col("dynamic_range") < t["low_dynamic_range"],
    }
    one = one.withColumns(flags).withColumn("flag_count", sum((F.col(f).cast("int") for f in flags), F.lit(0)))
    return one.withColumn("quality_status", F.when(F.col("flag_count") >= 2, "FAIL").when(F.col("flag_count") == 1, "REVIEW").otherwise("PASS"))
