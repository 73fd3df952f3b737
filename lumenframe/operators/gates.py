"""Fail-closed checks as tables of rules.

A rule is a name, a level and a condition that is true where a row breaks it. ``checked`` adds the names of
broken rules to each row, ``verdict`` counts them, ``passed`` says whether no error is left. Nothing is repaired.
Null, NaN and blank are missing. A column that the table lacks counts as missing everywhere; an empty table doesn't pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import INF, beside, missing, number, stripped
from ..schema import CANONICAL, EXPLORATORY_ROIS, ILLUMINATION, REFERENCE_TYPES, REQUIRED, ROIS, UNITS


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column
    level: str = "error"


def completed(df: DataFrame, columns: Sequence[str] = CANONICAL) -> DataFrame:
    """``df`` with null for each of ``columns`` that it lacks; an ``exposure`` stands in for ``exposure_us`` that is missing or null."""
    if "exposure" in df.columns and "exposure_us" in columns:
        df = df.withColumn("exposure_us", F.coalesce("exposure_us", "exposure") if "exposure_us" in df.columns else F.col("exposure"))
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


#: Columns that rules read as text without case and outer white space, and as numbers.
TEXTS = ("biomarker", "roi_type", "white_balance_mode", "illumination", "reference_type")
NUMBERS = ("target_value", "target_time_delta_min", "roi_x0", "roi_y0", "roi_x1", "roi_y1", "image_width", "image_height", "exposure_us", "iso", "working_distance_mm", "incidence_angle_deg", "bit_depth")


def flagged(df: DataFrame) -> DataFrame:
    """``df`` with every canonical column and what rules read of them: whether a value is missing, its lower case text and its number. Each is worked out once a row."""
    df = completed(df)
    kinds = dict(df.dtypes)
    blank = lambda c: (F.col(c).isNull() | F.isnan(c)) if kinds[c] in ("double", "float") else (F.col(c).isNull() | F.col(c).rlike(r"^\s*(?:NaN\s*)?$")) if kinds[c] == "string" else missing(c)
    return df.withColumns({f"_missing_{c}": blank(c) for c in CANONICAL} | {f"_low_{c}": F.lower(stripped(c)) for c in TEXTS} | {f"_number_{c}": number(c) for c in NUMBERS})


def absent(c: str) -> Column:
    """The flag of a column."""
    return F.col(f"_missing_{c}")


def low(c: str) -> Column:
    return F.col(f"_low_{c}")


def read(c: str) -> Column:
    """The number of a column."""
    return F.col(f"_number_{c}")


def limited(c: str) -> Column:
    """Whether a column's number is there and finite."""
    return F.coalesce(F.abs(read(c)) < INF, F.lit(False))


def checked(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``errors`` and ``warnings``: names of the rules that each row breaks, in the rules' order."""
    names = lambda level: F.array_compact(F.array(*(F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules if r.level == level))).cast("array<string>")
    return flagged(df).select(*df.columns, names("error").alias("errors"), names("warning").alias("warnings"))


def verdict(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, level, n) for every rule, in one pass: how many rows break it."""
    counted = flagged(df).agg(*(F.count_if(F.coalesce(r.broken, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)))
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.level).alias("level"), F.col(f"r{i}").alias("n")) for i, r in enumerate(rules)))
    return counted.select(F.explode(each).alias("x")).select("x.*")


def passed(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: n_rows, n_failed, n_warned and passed (rows, and none broken)."""
    broken = lambda level: reduce(lambda x, y: x | y, (F.coalesce(r.broken, F.lit(False)) for r in rules if r.level == level), F.lit(False))
    bad, warned = broken("error"), broken("warning")
    return flagged(df).agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_failed"), F.count_if(warned).alias("n_warned")).withColumn("passed", (F.col("n_rows") > 0) & (F.col("n_failed") == 0))


BOX = ("roi_x0", "roi_y0", "roi_x1", "roi_y1", "image_width", "image_height")


def passed_all(df: DataFrame, gates: Mapping[str, Sequence[Rule]]) -> DataFrame:
    """(gate, n_rows, n_failed, n_warned, passed) of several sets of rules, in one pass."""
    broken = lambda rules, level: reduce(lambda x, y: x | y, (F.coalesce(r.broken, F.lit(False)) for r in rules if r.level == level), F.lit(False))
    counts = [F.count_if(broken(rules, level)).alias(f"{level}{i}") for i, rules in enumerate(gates.values()) for level in ("error", "warning")]
    each = F.array(*(F.struct(F.lit(k).alias("gate"), F.col("n_rows"), F.col(f"error{i}").alias("n_failed"), F.col(f"warning{i}").alias("n_warned")) for i, k in enumerate(gates)))
    return flagged(df).agg(F.count("*").alias("n_rows"), *counts).select(F.explode(each).alias("x")).select("x.*", ((F.col("x.n_rows") > 0) & (F.col("x.n_failed") == 0)).alias("passed"))


def _whole_box() -> tuple[Column, Column]:
    """(all six numbers are there, all are finite integers)."""
    there, whole = F.lit(True), F.lit(True)
    for c in BOX:
        there = there & read(c).isNotNull()
        whole = whole & limited(c) & (F.floor(read(c)) == read(c))
    return there, whole


def box_inside() -> Column:
    x0, y0, x1, y1, w, h = (read(c) for c in BOX)
    return (w > 0) & (h > 0) & (x0 >= 0) & (x0 < x1) & (x1 <= w) & (y0 >= 0) & (y0 < y1) & (y1 <= h)


def box_sized(least: int = 8, low_share: float = 0.01, high_share: float = 0.95) -> Column:
    x0, y0, x1, y1, w, h = (read(c) for c in BOX)
    share = F.try_divide((x1 - x0) * (y1 - y0), w * h)
    return (x1 - x0 >= least) & (y1 - y0 >= least) & share.between(low_share, high_share)


def roi_rules(strict: bool = False) -> list[Rule]:
    there, whole = _whole_box()
    label = low("roi_type")
    approved = F.coalesce(*(F.when(low("biomarker") == b, label.isin(*rois)) for b, rois in ROIS.items()), F.lit(False))
    named = ~absent("roi_type") & ~absent("biomarker")
    level = "error" if strict else "warning"
    return [
        Rule("roi_unsupported", named & ~approved & ~label.isin(*EXPLORATORY_ROIS)),
        Rule("roi_exploratory", named & ~approved & label.isin(*EXPLORATORY_ROIS), level),
        Rule("roi_missing", absent("roi_type"), level),
        Rule("roi_incomplete", ~there, level),
        Rule("roi_not_integer", there & ~whole),
        Rule("roi_outside", there & whole & ~box_inside()),
        Rule("roi_size", there & whole & box_inside() & ~box_sized()),
    ]


def canonical_rules(strict_roi: bool = False) -> list[Rule]:
    """Required fields, target, biomarker, unit and ROI."""
    unit = F.coalesce(*(F.when(F.col("biomarker") == b, F.col("target_unit") != u) for b, u in UNITS.items()), F.lit(False))
    return [
        *(Rule(f"missing_{c}", absent(c)) for c in REQUIRED if c != "target_value"),
        Rule("target_not_numeric", read("target_value").isNull()),
        Rule("target_not_finite", read("target_value").isNotNull() & ~limited("target_value")),
        Rule("target_negative", read("target_value") < 0),
        Rule("biomarker_unknown", ~absent("biomarker") & ~F.col("biomarker").isin(*UNITS)),
        Rule("unit_unexpected", F.col("target_unit").isNotNull() & unit),
        *roi_rules(strict_roi),
    ]


def acquisition_rules() -> list[Rule]:
    """Seven required fields; where all are there, numbers in range, a locked white balance and a known light."""
    needed = ("device_model", "exposure_us", "iso", "white_balance_mode", "working_distance_mm", "incidence_angle_deg", "illumination")
    whole = ~F.greatest(*(absent(c) for c in needed))
    return [
        *(Rule(f"missing_{c}", absent(c)) for c in needed),
        *(Rule(f"{c}_invalid", whole & ~(limited(c) & (read(c) > 0))) for c in ("exposure_us", "iso", "working_distance_mm")),
        Rule("incidence_angle_deg_invalid", whole & ~(limited("incidence_angle_deg") & read("incidence_angle_deg").between(0, 90))),
        Rule("white_balance_auto", low("white_balance_mode").isin("auto", "awb")),
        Rule("illumination_unknown", whole & ~low("illumination").isin(*ILLUMINATION)),
        Rule("illumination_incomparable", ~absent("illumination") & ~low("illumination").isin(*ILLUMINATION), "warning"),
    ]


def physics_rules(require_raw: bool = False) -> list[Rule]:
    """Camera settings of a single capture; missing geometry is a warning."""
    depth = read("bit_depth")
    rules = [
        *(Rule(f"{c}_missing", F.col(c).isNull()) for c in ("exposure_us", "iso")),
        *(Rule(f"{c}_invalid", F.col(c).isNotNull() & ~(limited(c) & (read(c) > 0))) for c in ("exposure_us", "iso")),
        Rule("bit_depth_invalid", F.col("bit_depth").isNotNull() & ~(limited("bit_depth") & (F.floor(depth) == depth) & (depth >= 8))),
        Rule("white_balance_auto", F.coalesce(F.lower(F.col("white_balance_mode").cast("string")), F.lit("")).isin("", "auto", "awb")),
        Rule("distance_invalid", F.col("working_distance_mm").isNotNull() & ~(limited("working_distance_mm") & (read("working_distance_mm") > 0))),
        Rule("angle_invalid", F.col("incidence_angle_deg").isNotNull() & ~(limited("incidence_angle_deg") & read("incidence_angle_deg").between(0, 90))),
        Rule("format_missing", absent("image_format"), "warning"),
        Rule("distance_missing", F.col("working_distance_mm").isNull(), "warning"),
        Rule("angle_missing", F.col("incidence_angle_deg").isNull(), "warning"),
    ]
    return [Rule("raw_required", ~F.coalesce(F.col("raw_available").cast("boolean"), F.lit(False))), *rules] if require_raw else rules


TARGET_FIELDS = ("biomarker", "reference_measurement_id", "reference_method", "reference_type", "target_source", "target_unit")


def target_rules(biomarker: str | None = None, unit: str | None = None) -> list[Rule]:
    """Where a target value comes from."""
    whole = ~F.greatest(*(absent(c) for c in TARGET_FIELDS))
    rules = [
        *(Rule(f"missing_{c}", absent(c)) for c in TARGET_FIELDS),
        Rule("reference_type_unsupported", whole & ~low("reference_type").isin(*REFERENCE_TYPES)),
        Rule("time_delta_invalid", whole & ~absent("target_time_delta_min") & ~(limited("target_time_delta_min") & (read("target_time_delta_min") >= 0))),
    ]
    if biomarker is not None:
        rules.append(Rule("biomarker_mismatch", whole & (low("biomarker") != biomarker.strip().lower())))
    if unit is not None:
        rules.append(Rule("unit_mismatch", whole & (stripped("target_unit") != unit.strip())))
    return rules


def intake_rules(biomarker: str | None = None, unit: str | None = None) -> list[Rule]:
    """Rows of a delivered manifest. Zero is a valid setting here, and coordinates are cut to integers."""
    texts = ("patient_id", "image_id", "source_dataset", "biomarker", "target_unit", "target_source", "reference_method", "reference_measurement_id", "reference_type", "roi_type", "device_model", "illumination", "acquisition_id")
    settings = ("exposure_us", "iso", "working_distance_mm", "incidence_angle_deg")
    approved = F.coalesce(*(F.when(low("biomarker") == b, low("roi_type").isin(*rois)) for b, rois in ROIS.items()), F.lit(False))
    there, _ = _whole_box()
    rules = [
        *(Rule(f"missing_{c}", absent(c)) for c in texts),
        Rule("target_not_numeric", read("target_value").isNull()),
        *(Rule(f"missing_{c}", absent(c)) for c in settings),
        *(Rule(f"{c}_invalid", ~absent(c) & F.coalesce(read(c) < 0, F.lit(True))) for c in settings),
        Rule("missing_white_balance_mode", absent("white_balance_mode")),
        Rule("white_balance_auto", low("white_balance_mode").isin("auto", "awb", "automatic")),
        Rule("illumination_unsupported", ~F.coalesce(low("illumination").isin(*ILLUMINATION), F.lit(False))),
        Rule("roi_unsupported", ~approved),
        Rule("roi_invalid", ~F.coalesce(there & box_inside() & box_sized(), F.lit(False))),
    ]
    if biomarker is not None:
        rules.append(Rule("biomarker_mismatch", F.coalesce(low("biomarker") != biomarker.lower(), F.lit(True))))
    if unit is not None:
        rules.append(Rule("unit_mismatch", F.coalesce(stripped("target_unit") != unit, F.lit(True))))
    return rules


def repeated(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of non-blank values that more than one row holds."""
    return df.where(~missing(column)).groupBy(stripped(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def pair_rules(required: Sequence[str] = ("device_model", "exposure_us", "iso"), optional: Sequence[str] = ("working_distance_mm", "incidence_angle_deg", "white_balance_mode", "roi_type", "bit_depth", "image_format")) -> list[Rule]:
    """A flash and an ambient row of a pair (columns flash_* and ambient_*) under equal settings."""
    same = lambda c: F.col(f"flash_{c}").cast("string") == F.col(f"ambient_{c}").cast("string")
    rules = [Rule(f"{c}_differs", ~F.coalesce(same(c), F.lit(False))) for c in required]
    rules += [Rule(f"{c}_differs", (F.col(f"flash_{c}").isNotNull() | F.col(f"ambient_{c}").isNotNull()) & ~F.coalesce(same(c), F.lit(False))) for c in optional]
    return [*rules, Rule("white_balance_auto", F.lower(stripped("flash_white_balance_mode")).isin("auto", "awb"))]


def target_report(df: DataFrame, biomarker: str | None = None, unit: str | None = None, unique: bool = True) -> DataFrame:
    """One row: n_rows, n_failed, n_warned, n_reference_measurements, n_repeated_references, valid."""
    base = passed(df, target_rules(biomarker, unit))
    ids = df.agg(F.count_distinct("reference_measurement_id").alias("n_reference_measurements"))
    again = repeated(df, "reference_measurement_id").agg(F.count("*").alias("n_repeated_references"))
    out = beside(beside(base, ids), again)
    return out.withColumn("valid", F.col("passed") & ((F.col("n_repeated_references") == 0) | F.lit(not unique))).drop("passed")


def external_partition(external: DataFrame, development: DataFrame, biomarker: str, unit: str, dataset: str) -> DataFrame:
    """One row: n_records, n_patients, n_mismatched, n_shared_patients and valid, for data from elsewhere."""
    wrong = F.coalesce((F.col("biomarker") != biomarker) | (F.col("target_unit") != unit) | (F.col("dataset") != dataset), F.lit(True))
    base = external.agg(F.count("*").alias("n_records"), F.count_distinct("patient_id").alias("n_patients"), F.count_if(wrong).alias("n_mismatched"))
    shared = external.where("patient_id is not null").select("patient_id").distinct().join(development.select("patient_id").distinct(), "patient_id", "left_semi").agg(F.count("*").alias("n_shared_patients"))
    return beside(base, shared).withColumn("valid", (F.col("n_records") > 0) & (F.col("n_mismatched") == 0) & (F.col("n_shared_patients") == 0))


def participant_preflight(df: DataFrame, modalities: Sequence[str] = ("conjunctiva", "fingernails_open", "fingernails_closed", "tongue")) -> DataFrame:
    """Counts of a participant export before it is read; ``passed`` is always false, as a count proves no acquisition field."""
    df = completed(df, ["patient_uuid", "cbc_hgb_g_dl", "survey_haemoglobin", *(f"image_{m}" for m in modalities), *(f"camera_meta_{m}" for m in modalities)])
    cbc, survey = number("cbc_hgb_g_dl"), number("survey_haemoglobin")
    held = [F.max(F.col(f"image_{m}").isNotNull()).alias(f"has_{m}") for m in modalities]
    out = df.agg(F.count("*").alias("rows"), F.count_distinct(stripped("patient_uuid")).alias("patients"), F.count(cbc).alias("target_cbc_available"), F.count_if(cbc.isNull() & survey.isNotNull()).alias("target_survey_only"), *(F.count(f"camera_meta_{m}").alias(f"camera_{m}") for m in modalities), *held)
    present = F.array_compact(F.array(*(F.when(F.col(f"has_{m}"), F.lit(m)) for m in modalities)))
    return out.withColumns({"modalities_present": present, "modalities_missing": F.array_except(F.array(*map(F.lit, modalities)), present), "passed": F.lit(False)}).drop(*(f"has_{m}" for m in modalities))


def video_preflight(df: DataFrame) -> DataFrame:
    """Counts of a video manifest before it is read; never passes either."""
    df = completed(df, ["patient_id", "video_path", "hemoglobin_gdl", "reference_measurement_id"])
    target = number("hemoglobin_gdl")
    whole = ~missing("patient_id") & ~missing("video_path") & ~missing("reference_measurement_id") & target.isNotNull()
    return df.agg(F.count("*").alias("rows"), F.count_distinct(stripped("patient_id")).alias("patients"), F.count_if(~missing("video_path")).alias("videos_present"), F.count_if(missing("video_path")).alias("videos_missing"), F.count(target).alias("target_available"), F.count_if(whole).alias("provenance_complete")).withColumn("passed", F.lit(False))


def partition_identity(df: DataFrame) -> list[Rule]:
    """Every row of a partition names its patient, image and acquisition."""
    return [Rule(f"missing_{c}", absent(c)) for c in ("patient_id", "image_id", "acquisition_id")]


def first_repeat(df: DataFrame, key: str, order: str, alias: str = "duplicate_of") -> DataFrame:
    """``df`` with, for each later row of an equal non-null ``key``, the ``order`` of the first one."""
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return df.join(firsts, key, "left").withColumn(alias, F.when(F.col("_first") < F.col(order), F.col("_first"))).drop("_first")


