"""Measurements of whole images, each in the task that decodes it: one row out for one image in.

The same numbers as the expressions of ``pixels`` give over tables that already hold pixels. An image that can't be decoded or has
no usable region keeps its row, with the reason as its error and nulls for its numbers, so that whoever counts rows sees it.
Empty tables give empty results; extra columns of boxes are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import encode_bmp, open_output
from .pixels import CHANNELS, EPS, GRID, THRESHOLDS

#: Limits of the audit's flags (fixed values): gray mean, least gray spread and Laplacian variance, most saturated pixels.
BRIGHTNESS, LEAST_CONTRAST, LEAST_BLUR, MOST_SATURATED = (15.0, 240.0), 5.0, 20.0, 0.25


@dataclass(frozen=True)
class QualityLimits:
    """Thresholds of ``quality``: finite, not negative, and a share at most one."""

    low_sharpness: float = THRESHOLDS["low_sharpness"]
    high_illum_cv: float = THRESHOLDS["high_illum_cv"]
    high_saturation: float = THRESHOLDS["high_saturation"]
    low_dynamic_range: float = THRESHOLDS["low_dynamic_range"]

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            try:
                number = float(value)
            except (TypeError, ValueError):
                number = math.nan
            if isinstance(value, bool) or not math.isfinite(number) or number < 0 or (name == "high_saturation" and number > 1):
                raise ValueError(f"{name} must be a finite number that isn't negative, a share at most one")
            object.__setattr__(self, name, number)


@dataclass(frozen=True)
class RegionLimits:
    """Usable codes of ``region`` and the least share of pixels that must have them, with gains of a named calibration."""

    low: int = 1
    high: int = 254
    least: float = 0.80
    gains: tuple[float, float, float] = (1.0, 1.0, 1.0)
    calibration_id: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.low < self.high <= 255 or not 0 < self.least <= 1:
            raise ValueError("usable codes and their least share are out of range")
        if len(self.gains) != 3 or not all(math.isfinite(g) and g > 0 for g in self.gains) or (tuple(self.gains) != (1.0, 1.0, 1.0) and not self.calibration_id):
            raise ValueError("three positive gains and the id of their calibration are required")


def _linear_codes() -> np.ndarray:
    x = np.arange(256) / 255.0
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


_LINEAR = _linear_codes()


def _gray(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int64)
    return (19595 * c[..., 0] + 38470 * c[..., 1] + 7471 * c[..., 2] + 32768) >> 16


def features(rgb: np.ndarray, reference: Mapping[str, float] | None = None) -> dict[str, float]:
    light = _LINEAR[rgb].reshape(-1, 3)
    total = light.sum(axis=1)
    chroma = light / np.maximum(total, EPS)[:, None]
    mean = light.mean(axis=0)
    out = {"pixels": len(light), "linear_total_mean": total.mean()}
    for i, c in enumerate(CHANNELS):
        out |= {f"linear_{c}_mean": mean[i], f"linear_{c}_std": light[:, i].std(), f"chrom_{c}_mean": chroma[:, i].mean()}
        if reference:
            zero = _LINEAR[int(reference[c])]
            out[f"relative_od_{c}_mean"] = -np.log(np.maximum(light[:, i], 1e-6) / max(zero, 1e-6)).mean()
    ratio = lambda a, b: mean[a] / max(abs(mean[b]), EPS)
    return out | {"r_over_g": ratio(0, 1), "r_over_b": ratio(0, 2), "g_over_b": ratio(1, 2)}


def region(rgb: np.ndarray, limits: RegionLimits) -> dict[str, object]:
    ok = (rgb.min(axis=2) >= limits.low) & (rgb.max(axis=2) <= limits.high)
    share = float(ok.mean())
    passed = share >= limits.least
    light = np.maximum(_LINEAR[rgb[ok]] * np.asarray(limits.gains), 0.0) if passed else None
    means = {f"mean_{c}": float(light[:, i].mean()) if light is not None and len(light) else None for i, c in enumerate(CHANNELS)}
    return {"pixels": ok.size, "valid_fraction": share, "saturated_fraction": 1.0 - share if share == 1.0 else float((~ok).mean()), **means, "status": "PASS" if passed else "FAIL"}


def sharpness(rgb: np.ndarray) -> dict[str, object]:
    gray = _gray(rgb)
    edge = np.pad(gray, [(1, 1) if n > 1 else (0, 0) for n in gray.shape], mode="reflect")
    if gray.shape[0] == 1:
        edge = np.repeat(edge, 3, axis=0)
    if gray.shape[1] == 1:
        edge = np.repeat(edge, 3, axis=1)
    laplacian = edge[1:-1, :-2] + edge[1:-1, 2:] + edge[:-2, 1:-1] + edge[2:, 1:-1] - 4 * gray
    high, low = rgb.max(axis=2).astype(float), rgb.min(axis=2).astype(float)
    colour = np.where(high > 0, np.floor(255.0 * (high - low) / np.maximum(high, 1) + 0.5), 0.0)
    mean, spread, edges, rich = float(gray.mean()), float(gray.std()), float(laplacian.var()), float((colour >= 250).mean())
    return {
        "gray_mean": mean, "gray_std": spread, "laplacian_variance": edges, "dark_fraction": float((gray <= 10).mean()), "bright_fraction": float((gray >= 245).mean()), "saturated_fraction": rich,
        "brightness_ok": BRIGHTNESS[0] <= mean <= BRIGHTNESS[1], "contrast_ok": spread >= LEAST_CONTRAST, "blur_ok": edges >= LEAST_BLUR, "saturation_ok": rich <= MOST_SATURATED,
    }


def quality(rgb: np.ndarray, limits: QualityLimits) -> dict[str, object]:
    gray, codes = _gray(rgb), rgb.reshape(-1).astype(float)
    h, w = gray.shape
    blocks = np.array([b.mean() for row in np.array_split(gray, min(GRID, h), axis=0) for b in np.array_split(row, min(GRID, w), axis=1)])
    p01, p99 = np.percentile(codes, [1, 99])
    low, high, spread = float((codes <= 5).mean()), float((codes >= 250).mean()), float(gray.var())
    even = float(blocks.std() / blocks.mean()) if blocks.mean() > 0 else math.inf
    flags = {
        "flag_insufficient_dimensions": min(h, w) < GRID, "flag_low_sharpness": spread < limits.low_sharpness, "flag_high_illum_cv": even > limits.high_illum_cv,
        "flag_high_saturation": low + high > limits.high_saturation, "flag_low_dynamic_range": float(p99 - p01) < limits.low_dynamic_range,
    }
    n = sum(flags.values())
    return {
        "mean_intensity": codes.mean(), "std_intensity": codes.std(), "p01": p01, "p99": p99, "dynamic_range": p99 - p01, "low_clip_ratio": low, "high_clip_ratio": high, "saturation_ratio": low + high, "sharpness": spread,
        "illum_cv": even, **flags, "flag_count": n, "quality_status": "FAIL" if n >= 2 else "REVIEW" if n == 1 else "PASS",
    }


def _struct(example: Mapping[str, object]) -> pa.DataType:
    kind = lambda v: pa.string() if isinstance(v, str) else pa.bool_() if isinstance(v, bool | np.bool_) else pa.int64() if isinstance(v, int | np.integer) else pa.float64()
    return pa.struct([(k, kind(v)) for k, v in example.items()])


def _sql(kind: pa.DataType) -> str:
    names = {pa.string(): "string", pa.bool_(): "boolean", pa.int64(): "long", pa.float64(): "double"}
    return "struct<" + ", ".join(f"{f.name}: {names[f.type]}" for f in kind) + ">"


def _plain(found: Mapping[str, object]) -> dict[str, object]:
    return {k: v.item() if isinstance(v, np.generic) else v for k, v in found.items()}


def _cut(rgb: np.ndarray, box: Sequence[float | None], centre: float | None) -> np.ndarray:
    """The region of an image; ValueError says why there is none."""
    h, w, _ = rgb.shape
    if all(v is not None for v in box):
        if not all(math.isfinite(v) and v == int(v) for v in box):
            raise ValueError("the region's corners aren't whole numbers")
        x0, y0, x1, y1 = map(int, box)
        if not (0 <= x0 < x1 <= w and 0 <= y0 < y1 <= h):
            raise ValueError("the region lies outside the image")
        return rgb[y0:y1, x0:x1]
    if centre is None:
        raise ValueError("the image has no region")
    ch, cw = int(h * centre), int(w * centre)
    if not ch or not cw:
        raise ValueError("the image is too small for a centre region")
    return rgb[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw]


BOX = ("roi_x0", "roi_y0", "roi_x1", "roi_y1")


def measured(
    images: DataFrame, what: Sequence[str] = ("features", "region", "sharpness", "quality"), boxes: DataFrame | None = None, centre: float | None = None,
    reference: Mapping[str, float] | None = None, region_limits: RegionLimits | None = None, quality_limits: QualityLimits | None = None,
) -> DataFrame:
    """(path, width, height, error, and a struct for each of ``what``) of decoded images (see ``read_images``).

    ``boxes`` (path, roi_x0, roi_y0, roi_x1, roi_y1) cut regions out first, and an image without a whole box has an error; ``centre``, a share of each
    side that has to be asked for, is for demonstrations only. Without either, whole images are measured.
    """
    region_limits, quality_limits = region_limits or RegionLimits(), quality_limits or QualityLimits()
    makers = {"features": lambda a: features(a, reference), "region": lambda a: region(a, region_limits), "sharpness": sharpness, "quality": lambda a: quality(a, quality_limits)}
    some = np.random.default_rng(0).integers(50, 200, (12, 12, 3), dtype=np.uint8)
    kinds = {k: _struct(makers[k](some)) for k in what}
    whole = boxes is None and centre is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {c: b.column(c).to_pylist() for c in b.schema.names if c != "data"}
            errors, found = [], {k: [] for k in what}
            for i in range(b.num_rows):
                try:
                    if not rows["readable"][i]:
                        raise ValueError("the image can't be decoded")
                    w, h, n = rows["width"][i], rows["height"][i], rows["nChannels"][i]
                    a = np.frombuffer(b.column("data")[i].as_buffer(), np.uint8).reshape(h, w, n)
                    rgb = a[:, :, 2::-1] if n >= 3 else np.repeat(a[:, :, :1], 3, axis=2)
                    rgb = rgb if whole else _cut(rgb, [rows[c][i] for c in BOX], centre)
                    each = {k: _plain(makers[k](rgb)) for k in what}
                    errors.append(None)
                except ValueError as e:
                    errors.append(str(e))
                    each = dict.fromkeys(what)
                for k in what:
                    found[k].append(each[k])
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("width"), b.column("height"), pa.array(errors, pa.string()), *(pa.array(found[k], kinds[k]) for k in what)], names=["path", "width", "height", "error", *what])

    x = images.select("path", "width", "height", "nChannels", "readable", "data")
    if not whole:
        corners = [F.col(c).try_cast("double").alias(c) for c in BOX]
        x = x.join(boxes.select("path", *corners), "path", "left") if boxes is not None else x.select("*", *(F.lit(None).cast("double").alias(c) for c in BOX))
    return x.mapInArrow(run, "path string, width int, height int, error string, " + ", ".join(f"{k} {_sql(t)}" for k, t in kinds.items()))


def quality_audit(images: DataFrame) -> DataFrame:
    """Per image: levels and sharpness with four flags, or quality_error."""
    return measured(images, ("sharpness",)).select("path", "sharpness.*", F.col("error").alias("quality_error"))


AUDIT_FLAGS = ("brightness_ok", "contrast_ok", "blur_ok", "saturation_ok")


def audit_checks(inventory: DataFrame, audited: DataFrame, split_clean: bool) -> DataFrame:
    """(name, ok) of what a data set must meet before it is learned from; without files nothing is met.

    ``inventory`` has exists, readable and sha256, ``audited`` is a ``quality_audit``.
    """
    every = lambda c: F.coalesce(F.every(F.coalesce(c, F.lit(False))), F.lit(False))
    flags: Column = F.least(*(F.col(c) for c in AUDIT_FLAGS))
    files = inventory.agg(every(F.col("exists")).alias("all_images_exist"), every(F.col("readable")).alias("all_images_readable"), (F.count("*") > 0).alias("some"))
    twice = inventory.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n")).agg((F.count_if(F.col("n") > 1) == 0).alias("exact_duplicate_free"))
    seen = audited.agg(every(F.col("quality_error").isNull()).alias("quality_extraction_complete"), every(flags).alias("optical_quality_gate"))
    parts = [(files, ("all_images_exist", "all_images_readable")), (twice, ("exact_duplicate_free",)), (seen, ("quality_extraction_complete", "optical_quality_gate"))]
    rows = [df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("ok")) for c in names))).alias("x")).select("x.*") for df, names in parts]
    split = inventory.sparkSession.createDataFrame([("patient_split_clean", bool(split_clean))], "name string, ok boolean")
    return rows[0].union(rows[1]).union(rows[2]).union(split)


def write_images(pixels: DataFrame, folder: str) -> int:
    """Each whole image of a table of pixels (image_id, y, x, r, g, b) as a file ``<image_id>.bmp`` of shared storage, one image in a task at a time; returns how many.

    Rows of a pixel table that don't fill a row of the image are left out.
    """

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        w = int(pdf["x"].max()) + 1
        full = pdf.groupby("y")["x"].transform("count") == w
        p = pdf[full].sort_values(["y", "x"])
        if len(p):
            rgb = p[list(CHANNELS)].to_numpy().astype(np.uint8).reshape(-1, w, 3)
            with open_output(f"{folder}/{pdf['image_id'].iloc[0]}.bmp") as f:
                f.write(encode_bmp(rgb))
        return pd.DataFrame({"n": [int(len(p) > 0)]})

    return int(pixels.groupBy("image_id").applyInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0)
