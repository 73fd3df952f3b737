"""Queries of gates, profiles, overlaps, splits, adapters and pixel features over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import number, rounded
from ..operators import adapters as a
from ..operators import gates as g
from ..operators import images as im
from ..operators import pixels as px
from ..operators import relations as rel
from ..schema import CANONICAL, ColumnMapping
from ..sources.files import read_images
from ..sources.tables import table
from .staging import fresh_path


def _captures(spark: SparkSession, d: str) -> DataFrame:
    """The canonical columns of captures; a NaN target is null."""
    c = table(spark, d, "captures").select("record_id", "split_name", *CANONICAL)
    return c.withColumn("target_value", number("target_value"))


def gate_canonical(spark: SparkSession, d: str) -> DataFrame:
    return g.verdict(_captures(spark, d), g.canonical_rules())


def gate_acquisition(spark: SparkSession, d: str) -> DataFrame:
    return g.verdict(_captures(spark, d), g.acquisition_rules())


def gate_physics(spark: SparkSession, d: str) -> DataFrame:
    return g.verdict(_captures(spark, d), g.physics_rules(require_raw=True))


def gate_target(spark: SparkSession, d: str) -> DataFrame:
    return g.verdict(_captures(spark, d), g.target_rules())


def gate_intake(spark: SparkSession, d: str) -> DataFrame:
    return g.verdict(table(spark, d, "intake_manifest"), g.intake_rules())


def gate_passed(spark: SparkSession, d: str) -> DataFrame:
    """Every gate with its rows that fail."""
    c = _captures(spark, d)
    return g.passed_all(c, {"canonical": g.canonical_rules(), "acquisition": g.acquisition_rules(), "target": g.target_rules(), "identity": g.partition_identity(c)})


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each row with its broken rules, as text."""
    return g.checked(_captures(spark, d), g.acquisition_rules()).where("size(errors) > 0").select("record_id", F.array_join("errors", ",").alias("errors"))


def target_report(spark: SparkSession, d: str) -> DataFrame:
    return g.target_report(_captures(spark, d))


def external_partition(spark: SparkSession, d: str) -> DataFrame:
    c = _captures(spark, d).withColumn("dataset", F.col("source_dataset"))
    return g.external_partition(c.where("source_dataset = 'kiosk_walkin'"), c.where("source_dataset <> 'kiosk_walkin'"), "hemoglobin", "g/dL", "kiosk_walkin")


def missing_fractions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.missingness(_captures(spark, d)))


def target_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.target_summary(_captures(spark, d)))


def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    return rel.leakage_report(_captures(spark, d))


def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    return rel.leakage_audit(_captures(spark, d))


def device_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.device_distribution(_captures(spark, d)))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "inventory")
    return rel.status_counts(f, F.when(~F.col("file_exists"), "FAIL").when(~F.col("readable"), "REVIEW").otherwise("PASS"))


def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return rel.duplicate_rows(table(spark, d, "inventory").select("file_id", "sha256"), "sha256")


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the same bytes as an earlier one."""
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return g.first_repeat(t, "sha256", "doc_id").where("duplicate_of is not null").select("doc_id", "duplicate_of")


def overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return rel.overlap_counts(_captures(spark, d), "split_name", ["patient_id", "acquisition_id", "image_id"])


def partition_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return rel.partition_overlaps(_captures(spark, d), "split_name", ["patient_id", "acquisition_id", "image_id"])


def patient_split(spark: SparkSession, d: str) -> DataFrame:
    c = _captures(spark, d).where("trim(patient_id) <> ''").select("record_id", "patient_id")
    return rel.patient_split(c).select("record_id", "partition")


def split_by_biomarker(spark: SparkSession, d: str) -> DataFrame:
    c = _captures(spark, d).where("trim(patient_id) <> ''").select("biomarker", "patient_id")
    return rel.split_by(c).groupBy("biomarker", "partition").agg(F.count("*").alias("n"))


def unseen_device_split(spark: SparkSession, d: str) -> DataFrame:
    return rel.unseen_device_split(_captures(spark, d), "Norvik P4", strict=False).groupBy("partition").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))


def audit_gate(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "inventory").agg(F.every("file_exists").alias("exists"), F.every("readable").alias("readable"), (F.count("*") > 0).alias("rows"))
    return rel.audit_gate(f.selectExpr("stack(3, 'exists', exists, 'readable', readable, 'rows', rows) as (name, ok)"))


def canonical_table(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "intake_manifest")
    return a.build_canonical(raw, ColumnMapping("patient_id", "image_path", "target_value", device_model="device_model", iso="iso", working_distance_mm="working_distance_mm"), "intake", "Hemoglobin", "g/dL").select("patient_id", "image_id", "acquisition_id", "biomarker", "target_value", "iso", "working_distance_mm", "raw_available")


def camera_values(spark: SparkSession, d: str) -> DataFrame:
    """A value out of the JSON of events, and the light that a flash word stands for."""
    e = table(spark, d, "events").select("event_id", a.camera_value(F.col("props"), ["absent", "k"]).cast("int").alias("k"), "event_type")
    return e.groupBy("event_type", a.illumination_of_flash(F.when(F.col("k") % 5 == 0, "OFF").when(F.col("k") % 5 == 1, "torch").otherwise("?")).alias("light")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_catalog").select("field_name", a.normalized_text("meaning").alias("name"))


def participant_images(spark: SparkSession, d: str) -> DataFrame:
    """The adapter over parsed export lines: one row for each image with a blood or reported value."""
    from ..operators.schema_drift import union_schema, union_table, file_fields  # noqa: I001
    from .intake import catalog

    rows, names = table(spark, d, "export_rows"), catalog(spark, d)
    t = union_table(rows, names, union_schema(file_fields(rows, names), names)).where("participant_uuid is not null")
    out = a.adapt_participants(t)
    return out.groupBy("roi_type", "reference_method").agg(F.count("*").alias("images"), F.round(F.avg("target_value"), 6).alias("target"), F.count("iso").alias("with_iso"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Line items as pixels: one image a supplier, 16 wide, rows filled in key order."""
    from pyspark.sql import Window as W

    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    at = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber")) - 1
    p = li.withColumn("at", at).selectExpr("l_suppkey as image_id", "cast(floor(at / 16) as int) as y", "cast(at % 16 as int) as x", "cast(l_partkey % 256 as int) as r", "cast(l_suppkey * 7 % 256 as int) as g", "cast(l_quantity * 5 as int) % 256 as b")
    return p


def pixel_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(px.features(_pixels(spark, d), {"r": 180, "g": 180, "b": 180}))


def pixel_regions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(px.valid_region(_pixels(spark, d), (2.0, 1.0, 0.5), "bench-1"))


def pixel_crops(spark: SparkSession, d: str) -> DataFrame:
    p = _pixels(spark, d)
    boxes = p.select("image_id").distinct().selectExpr("image_id", "2 as roi_x0", "1 as roi_y0", "10 as roi_x1", "6 as roi_y1")
    return rounded(px.valid_region(px.cropped(p, boxes)))


def pixel_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(px.sharpness(_pixels(spark, d)))


def pixel_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(px.assessed(_pixels(spark, d)))


def _image_files(spark: SparkSession, d: str) -> DataFrame:
    """The same images as files, decoded by Spark."""
    folder = fresh_path(spark, "images")
    im.write_images(_pixels(spark, d), folder)
    return read_images(spark, folder)


def _of_file(df: DataFrame, *what: str) -> DataFrame:
    return df.select(F.regexp_extract("path", r"([0-9]+)\.bmp$", 1).cast("long").alias("image_id"), *(f"{w}.*" for w in what))


def image_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_of_file(im.measured(_image_files(spark, d), ("features",), reference={"r": 180, "g": 180, "b": 180}), "features"))


def image_regions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_of_file(im.measured(_image_files(spark, d), ("region",), region_limits=im.RegionLimits(gains=(2.0, 1.0, 0.5), calibration_id="bench-1")), "region"))


def image_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_of_file(im.measured(_image_files(spark, d), ("quality",)), "quality"))


def image_audit(spark: SparkSession, d: str) -> DataFrame:
    """Levels, sharpness and the four flags of each file."""
    a = im.quality_audit(_image_files(spark, d))
    return rounded(_of_file(a.select("path", F.struct("*").alias("all")), "all").drop("path"))


def pixel_flash(spark: SparkSession, d: str) -> DataFrame:
    """Images against the image of the next supplier, as flash and ambient."""
    p = _pixels(spark, d)
    diff = px.lit_minus_ambient(p, p.withColumn("image_id", F.col("image_id") - 1), (1.0, 0.9, 1.1))
    return rounded(diff.groupBy("image_id").agg(F.count("*").alias("pixels"), *(F.avg(f"d{c}").alias(f"d{c}") for c in "rgb")))


def absorption_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' balances as concentrations of nations, nations' keys as extinctions."""
    spectra = table(spark, d, "nation").selectExpr("n_nationkey as chromophore", "explode(sequence(400, 700, 100)) as wavelength").withColumn("extinction", (F.col("wavelength") % 7 + F.col("chromophore")) / 10)
    conc = table(spark, d, "supplier").selectExpr("s_suppkey as sample_id", "s_nationkey as chromophore", "abs(s_acctbal) / 1000 as concentration")
    out = px.absorption(spectra, conc)
    return rounded(out.withColumn("transmitted", px.attenuation(F.col("absorption") / 100, F.lit(0.01), F.lit(1.0))))


def _queries() -> dict:
    found = (
        gate_canonical, gate_acquisition, gate_physics, gate_target, gate_intake, gate_passed, gate_rows, target_report, external_partition, missing_fractions, target_summary, leakage_report, leakage_audit, device_distribution, status_counts, duplicate_rows, duplicate_texts,
        overlap_counts, partition_overlaps, patient_split, split_by_biomarker, unseen_device_split, audit_gate, canonical_table, camera_values, normalized_names, participant_images, pixel_features, pixel_regions, pixel_crops, pixel_sharpness, pixel_quality, pixel_flash, absorption_spectra, image_features, image_regions, image_quality, image_audit,
    )
    return {f.__name__: f for f in found}


QUERIES = _queries()

_C = "c as (select * replace (case when isnan(target_value) then null else target_value end as target_value) from captures)"


def _miss(c: str, text: bool = True) -> str:
    return f"({c} is null or regexp_replace({c}, '^\\s+|\\s+$', '', 'g') = '')" if text else f"({c} is null or isnan({c}))"


def _low(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


def _verdict(source: str, rules: dict[str, tuple[str, str]]) -> str:
    cases = ", ".join(f"count(*) filter ({cond}) as r{i}" for i, (cond, _) in enumerate(rules.values()))
    return f"with {source}, v as (select {cases} from c) " + " union all ".join(f"select '{k}' as rule, '{level}' as level, r{i} as n from v" for i, (k, (_, level)) in enumerate(rules.items()))


_OK_ROI = f"(({_low('biomarker')} = 'hemoglobin' and {_low('roi_type')} in ('conjunctiva', 'nailbed')) or ({_low('biomarker')} = 'bilirubin' and {_low('roi_type')} in ('forehead', 'sternum', 'abdomen')))"
_NAMED = f"(not {_miss('roi_type')} and not {_miss('biomarker')})"
_BOXED = " and ".join(f"{c} is not null" for c in g.BOX)
_WHOLE = " and ".join(f"isfinite({c}::double) and floor({c}) = {c}" for c in g.BOX)
_IN = "image_width > 0 and image_height > 0 and roi_x0 >= 0 and roi_x0 < roi_x1 and roi_x1 <= image_width and roi_y0 >= 0 and roi_y0 < roi_y1 and roi_y1 <= image_height"
_SIZED = "roi_x1 - roi_x0 >= 8 and roi_y1 - roi_y0 >= 8 and (roi_x1 - roi_x0) * (roi_y1 - roi_y0) / (image_width * image_height) between 0.01 and 0.95"
_CANON = {
    **{f"missing_{c}": (_miss(c), "error") for c in ("patient_id", "image_id", "image_path", "source_dataset", "biomarker", "target_unit")},
    "target_not_numeric": ("target_value is null", "error"), "target_not_finite": ("not isfinite(target_value)", "error"), "target_negative": ("target_value < 0", "error"),
    "biomarker_unknown": (f"not {_miss('biomarker')} and biomarker not in ('hemoglobin', 'bilirubin')", "error"), "unit_unexpected": ("(biomarker = 'hemoglobin' and target_unit <> 'g/dL') or (biomarker = 'bilirubin' and target_unit <> 'mg/dL')", "error"),
    "roi_unsupported": (f"{_NAMED} and not {_OK_ROI} and {_low('roi_type')} not in ('tongue', 'fingertip')", "error"), "roi_exploratory": (f"{_NAMED} and not {_OK_ROI} and {_low('roi_type')} in ('tongue', 'fingertip')", "warning"), "roi_missing": (_miss("roi_type"), "warning"),
    "roi_incomplete": (f"not ({_BOXED})", "warning"), "roi_not_integer": (f"{_BOXED} and not ({_WHOLE})", "error"), "roi_outside": (f"{_BOXED} and {_WHOLE} and not ({_IN})", "error"), "roi_size": (f"{_BOXED} and {_WHOLE} and {_IN} and not ({_SIZED})", "error"),
}
_TEXTS = ("device_model", "white_balance_mode", "illumination")
_NEED = ("device_model", "exposure_us", "iso", "white_balance_mode", "working_distance_mm", "incidence_angle_deg", "illumination")
_ALL = "not (" + " or ".join(_miss(c, c in _TEXTS) for c in _NEED) + ")"
_ACQ = {
    **{f"missing_{c}": (_miss(c, c in _TEXTS), "error") for c in _NEED},
    **{f"{c}_invalid": (f"{_ALL} and not (isfinite({c}) and {c} > 0)", "error") for c in ("exposure_us", "iso", "working_distance_mm")},
    "incidence_angle_deg_invalid": (f"{_ALL} and not (isfinite(incidence_angle_deg) and incidence_angle_deg between 0 and 90)", "error"), "white_balance_auto": (f"{_low('white_balance_mode')} in ('auto', 'awb')", "error"),
    "illumination_unknown": (f"{_ALL} and {_low('illumination')} not in ('flash', 'ambient', 'controlled_led', 'reference')", "error"), "illumination_incomparable": (f"not {_miss('illumination')} and {_low('illumination')} not in ('flash', 'ambient', 'controlled_led', 'reference')", "warning"),
}
_PHYS = {
    "raw_required": ("not coalesce(raw_available, false)", "error"), "exposure_us_missing": ("exposure_us is null", "error"), "iso_missing": ("iso is null", "error"),
    **{f"{c}_invalid": (f"{c} is not null and not (isfinite({c}) and {c} > 0)", "error") for c in ("exposure_us", "iso")},
    "bit_depth_invalid": ("bit_depth is not null and not (isfinite(bit_depth) and floor(bit_depth) = bit_depth and bit_depth >= 8)", "error"), "white_balance_auto": ("coalesce(lower(white_balance_mode), '') in ('', 'auto', 'awb')", "error"),
    "distance_invalid": ("working_distance_mm is not null and not (isfinite(working_distance_mm) and working_distance_mm > 0)", "error"), "angle_invalid": ("incidence_angle_deg is not null and not (isfinite(incidence_angle_deg) and incidence_angle_deg between 0 and 90)", "error"),
    "format_missing": (_miss("image_format"), "warning"), "distance_missing": ("working_distance_mm is null", "warning"), "angle_missing": ("incidence_angle_deg is null", "warning"),
}
_TFIELDS = "not (" + " or ".join(_miss(c) for c in g.TARGET_FIELDS) + ")"
_TARGET = {
    **{f"missing_{c}": (_miss(c), "error") for c in g.TARGET_FIELDS},
    "reference_type_unsupported": (f"{_TFIELDS} and {_low('reference_type')} not in ('laboratory', 'validated_reference')", "error"),
    "time_delta_invalid": (f"{_TFIELDS} and target_time_delta_min is not null and not isnan(target_time_delta_min) and not (isfinite(target_time_delta_min) and target_time_delta_min >= 0)", "error"),
}
_ITEXT = ("patient_id", "image_id", "source_dataset", "biomarker", "target_unit", "target_source", "reference_method", "reference_measurement_id", "reference_type", "roi_type", "device_model", "illumination", "acquisition_id")
_NUM = lambda c: f"(case when not isnan(try_cast({c} as double)) then try_cast({c} as double) end)"
_SETTINGS = {"exposure_us": False, "iso": False, "working_distance_mm": True, "incidence_angle_deg": True}


def _imiss(c: str, text: bool) -> str:
    return f"({c} is null or regexp_replace({c}::varchar, '^\\s+|\\s+$', '', 'g') in ('', 'NaN'))"


_INTAKE = {
    **{f"missing_{c}": (_imiss(c, True), "error") for c in _ITEXT},
    "target_not_numeric": (f"{_NUM('target_value')} is null", "error"),
    **{f"missing_{c}": (_imiss(c, t), "error") for c, t in _SETTINGS.items()},
    **{f"{c}_invalid": (f"not {_imiss(c, t)} and coalesce({_NUM(c)} < 0, true)", "error") for c, t in _SETTINGS.items()},
    "missing_white_balance_mode": (_imiss("white_balance_mode", True), "error"), "white_balance_auto": (f"{_low('white_balance_mode')} in ('auto', 'awb', 'automatic')", "error"),
    "illumination_unsupported": (f"not coalesce({_low('illumination')} in ('flash', 'ambient', 'controlled_led', 'reference'), false)", "error"), "roi_unsupported": (f"not coalesce({_OK_ROI}, false)", "error"), "roi_invalid": (f"not coalesce({_BOXED} and {_IN} and {_SIZED}, false)", "error"),
}


def _any(rules: dict[str, tuple[str, str]], level: str) -> str:
    return "coalesce(" + (" or ".join(f"coalesce({c}, false)" for c, lv in rules.values() if lv == level) or "false") + ", false)"


_IDENT = {f"missing_{c}": (_miss(c), "error") for c in ("patient_id", "image_id", "acquisition_id")}
_PX = """px as (select l_suppkey as image_id, (n // 16)::int as y, (n % 16)::int as x, (l_partkey % 256)::int as r, (l_suppkey * 7 % 256)::int as g, (floor(l_quantity * 5)::int % 256) as b from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber) - 1 as n from lineitem))"""
_LIN = lambda c: f"(case when least(greatest({c} / 255.0::double, 0), 1) <= 0.04045 then least(greatest({c} / 255.0::double, 0), 1) / 12.92 else pow((least(greatest({c} / 255.0::double, 0), 1) + 0.055) / 1.055, 2.4) end)"
_LP = f"{_PX}, lp as (select *, {_LIN('r')} as lr, {_LIN('g')} as lg, {_LIN('b')} as lb from px)"
_GRAY = "floor((19595 * r + 38470 * g + 7471 * b + 32768) / 65536)"


def _region(source: str, gains: tuple[float, float, float], where: str = "true") -> str:
    ok = "least(r, g, b) >= 1 and greatest(r, g, b) <= 254"
    means = ", ".join(f"case when avg(({ok})::int) >= 0.8 then round(avg(greatest(l{c} * {k}, 0)) filter ({ok}), 6) end as mean_{c}" for c, k in zip("rgb", gains, strict=True))
    return f"with {source} select image_id, count(*) as pixels, round(avg(({ok})::int), 6) as valid_fraction, round(avg((not ({ok}))::int), 6) as saturated_fraction, {means}, case when avg(({ok})::int) >= 0.8 then 'PASS' else 'FAIL' end as status from lp where {where} group by image_id"


def _split(source: str) -> str:
    return f"""{source}, k as (select *, row_number() over (partition by part order by h, p) - 1 as i, count(*) over (partition by part) as n from (select distinct part, p, md5('42-' || p) as h from c)),
s as (select part, p, case when i < floor(n * 0.7) then 'train' when i < floor(n * 0.7) + floor((n - floor(n * 0.7)) * 0.15 / (1 - 0.7)) then 'validation' else 'test' end as partition from k)"""


_OVER = """e as (select split_name as part, unnest([{'k': 'patient_id', 'i': patient_id}, {'k': 'acquisition_id', 'i': acquisition_id}, {'k': 'image_id', 'i': image_id}]) as x from captures), h as (select distinct part, x.k as kind, x.i as id from e where x.i is not null and part is not null)"""

SQL = {
    "gate_canonical": _verdict(_C, _CANON), "gate_acquisition": _verdict(_C, _ACQ), "gate_physics": _verdict(_C, _PHYS), "gate_target": _verdict(_C, _TARGET), "gate_intake": _verdict("c as (select * from intake_manifest)", _INTAKE),
    "gate_passed": f"with {_C} " + " union all ".join(f"select '{k}' as gate, count(*) as n_rows, count(*) filter ({_any(r, 'error')}) as n_failed, count(*) filter ({_any(r, 'warning')}) as n_warned, count(*) > 0 and count(*) filter ({_any(r, 'error')}) = 0 as passed from c" for k, r in {"canonical": _CANON, "acquisition": _ACQ, "target": _TARGET, "identity": _IDENT}.items()),
    "gate_rows": f"with {_C}, e as (select record_id, concat_ws(',', " + ", ".join(f"case when {c} then '{k}' end" for k, (c, lv) in _ACQ.items() if lv == "error") + ") as errors from c) select * from e where errors <> ''",
    "target_report": f"with {_C}, i as (select trim(reference_measurement_id) as v, count(*) as k from c where not {_miss('reference_measurement_id')} group by 1 having k > 1) select count(*) as n_rows, count(*) filter ({_any(_TARGET, 'error')}) as n_failed, 0 as n_warned, count(distinct reference_measurement_id) as n_reference_measurements, (select count(*) from i) as n_repeated_references, count(*) > 0 and count(*) filter ({_any(_TARGET, 'error')}) = 0 and (select count(*) from i) = 0 as valid from c",
    "external_partition": f"""with {_C}, x as (select * from c where source_dataset = 'kiosk_walkin'), s as (select count(distinct patient_id) as n from x where patient_id in (select patient_id from c where source_dataset <> 'kiosk_walkin'))
select count(*) as n_records, count(distinct patient_id) as n_patients, count(*) filter (coalesce(biomarker <> 'hemoglobin' or target_unit <> 'g/dL', true)) as n_mismatched, (select n from s) as n_shared_patients, count(*) > 0 and count(*) filter (coalesce(biomarker <> 'hemoglobin' or target_unit <> 'g/dL', true)) = 0 and (select n from s) = 0 as valid from x""",
    "missing_fractions": f"with {_C} " + " union all ".join(f"select '{c}' as \"column\", round(avg(({c} is null)::int), 6) as missing_fraction from c" for c in ("record_id", "split_name", *CANONICAL)),
    "target_summary": f"with {_C} select biomarker, target_unit, count(target_value) as count, round(min(target_value), 6) as min, round(max(target_value), 6) as max, round(avg(target_value), 6) as mean, round(median(target_value), 6) as median, round(stddev_samp(target_value), 6) as std from c where biomarker is not null and target_unit is not null group by all",
    "leakage_report": "with p as (select patient_id, count(*) as n from captures group by 1) select count(patient_id) as patients, sum(n)::bigint as records, count(*) filter (n > 1 and patient_id is not null) as patients_with_multiple_records from p",
    "leakage_audit": """select count(*) as n_rows, count(distinct patient_id) as n_patients, count(*) - count(distinct patient_id) - max((patient_id is null)::int) as duplicate_patient_rows, count(*) - count(distinct acquisition_id) - max((acquisition_id is null)::int) as duplicate_acquisition_rows,
(select count(*) - count(distinct patient_id) from (select distinct patient_id, device_model from captures where patient_id is not null and device_model is not null)) as patients_seen_on_multiple_devices from captures""",
    "device_distribution": "select device_model, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as fraction from captures group by 1",
    "status_counts": "select count(*) as n, count(*) filter (file_exists and readable) as pass, count(*) filter (file_exists and not readable) as review, count(*) filter (not file_exists) as fail, round(pass / n, 6) as pass_rate, round(review / n, 6) as review_rate, round(fail / n, 6) as fail_rate from inventory",
    "duplicate_rows": "select file_id, sha256 from (select *, count(*) over (partition by sha256) as k from inventory where sha256 is not null) where k > 1",
    "duplicate_texts": "select doc_id, f as duplicate_of from (select doc_id, min(doc_id) over (partition by sha256(text)) as f from documents where text is not null) where f < doc_id",
    "overlap_counts": f"with {_OVER}, n as (select distinct split_name as p from captures where split_name is not null) select k.kind, x.p as a, y.p as b, (select count(*) from h h1 join h h2 on h1.kind = h2.kind and h1.id = h2.id where h1.kind = k.kind and h1.part = x.p and h2.part = y.p) as n from n x join n y on x.p < y.p, (values ('patient_id'), ('acquisition_id'), ('image_id')) k(kind)",
    "partition_overlaps": f"with {_OVER} select h1.kind, h1.part as a, h2.part as b, h1.id from h h1 join h h2 on h1.kind = h2.kind and h1.id = h2.id and h1.part < h2.part",
    "patient_split": "with c as (select record_id, regexp_replace(patient_id, '^\\s+|\\s+$', '', 'g') as p, 1 as part from captures where trim(patient_id, ' ') <> ''), " + _split("z as (select 1)") + " select record_id, partition from c join s using (part, p)",
    "split_by_biomarker": "with c as (select biomarker as part, regexp_replace(patient_id, '^\\s+|\\s+$', '', 'g') as p from captures where trim(patient_id, ' ') <> '' and biomarker is not null), " + _split("z as (select 1)") + " select part as biomarker, partition, count(*) as n from c join s using (part, p) group by all",
    "unseen_device_split": """with t as (select distinct patient_id from captures where device_model = 'Norvik P4'), m as (select c.patient_id, case when device_model = 'Norvik P4' then 'test' when t.patient_id is not null or (c.patient_id is null and exists (select 1 from t where patient_id is null)) then 'excluded' else 'train' end as partition from captures c left join t on t.patient_id = c.patient_id)
select partition, count(*) as n, count(distinct patient_id) as patients from m group by 1""",
    "audit_gate": "select 3 as checks, coalesce(bool_and(file_exists) and bool_and(readable) and count(*) > 0, false) as passed from inventory",
    "canonical_table": f"""with c as (select *, regexp_replace(patient_id, '^\\s+|\\s+$', '', 'g') as p, regexp_replace(image_path, '^\\s+|\\s+$', '', 'g') as f from intake_manifest), k as (select *, concat_ws('_', p, regexp_extract(f, '([^/\\\\]+?)(\\.[^./\\\\]*)?$', 1)) as i from c)
select p as patient_id, i as image_id, i as acquisition_id, 'hemoglobin' as biomarker, {_NUM('target_value')} as target_value, iso, {_NUM('working_distance_mm')} as working_distance_mm, false as raw_available from k""",
    "camera_values": "with e as (select event_type, (props::json->>'k')::int as k from events) select event_type, case when k % 5 = 0 then 'ambient' when k % 5 = 1 then 'flash' end as light, count(*) as n, sum(k)::bigint as total from e group by all",
    "normalized_names": "select field_name, regexp_replace(regexp_replace(lower(trim(meaning)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as name from field_catalog",
    "pixel_features": f"""with {_LP} select image_id, count(*) as pixels, {", ".join(f"round(avg(l{c}), 6) as linear_{c}_mean, round(stddev_pop(l{c}), 6) as linear_{c}_std, round(avg(l{c} / greatest(lr + lg + lb, 1e-8)), 6) as chrom_{c}_mean, round(avg(-ln(greatest(l{c}, 1e-6) / greatest({_LIN('180')}, 1e-6))), 6) as relative_od_{c}_mean" for c in "rgb")},
round(avg(lr + lg + lb), 6) as linear_total_mean, round(avg(lr) / greatest(abs(avg(lg)), 1e-8), 6) as r_over_g, round(avg(lr) / greatest(abs(avg(lb)), 1e-8), 6) as r_over_b, round(avg(lg) / greatest(abs(avg(lb)), 1e-8), 6) as g_over_b from lp group by image_id""",
    "pixel_regions": _region(_LP, (2.0, 1.0, 0.5)),
    "pixel_crops": _region(_LP, (1.0, 1.0, 1.0), "x >= 2 and x < 10 and y >= 1 and y < 6"),
    "pixel_sharpness": f"""with {_PX}, v as (select *, {_GRAY} as v, case when greatest(r, g, b) > 0 then round(255.0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)) else 0 end as s from px),
n as (select *, lag(v) over rw as le, lead(v) over rw as ri, lag(v) over cl as up, lead(v) over cl as dn from v window rw as (partition by image_id, y order by x), cl as (partition by image_id, x order by y)),
l as (select *, coalesce(le, ri, v) + coalesce(ri, le, v) + coalesce(up, dn, v) + coalesce(dn, up, v) - 4 * v as lap from n)
select image_id, round(avg(v), 6) as gray_mean, round(stddev_pop(v), 6) as gray_std, round(var_pop(lap), 6) as laplacian_variance, round(avg((v <= 10)::int), 6) as dark_fraction, round(avg((v >= 245)::int), 6) as bright_fraction, round(avg((s >= 250)::int), 6) as saturated_fraction from l group by image_id""",
    "pixel_quality": f"""with {_PX}, s as (select image_id, max(x) + 1 as w, max(y) + 1 as h, var_pop({_GRAY}) as sharp from px group by 1), c as (select image_id, unnest([r, g, b]) as c from px),
q as (select image_id, avg(c) as m, stddev_pop(c) as sd, quantile_cont(c, 0.01) as p01, quantile_cont(c, 0.99) as p99, avg((c <= 5)::int) as lo, avg((c >= 250)::int) as hi from c group by 1),
k as (select px.*, {_GRAY} as v, w, h, least(10, w) as kx, least(10, h) as ky from px join s using (image_id)),
b as (select image_id, case when y < (h % ky) * (h // ky + 1) then y // (h // ky + 1) else h % ky + (y - (h % ky) * (h // ky + 1)) // (h // ky) end as by_, case when x < (w % kx) * (w // kx + 1) then x // (w // kx + 1) else w % kx + (x - (w % kx) * (w // kx + 1)) // (w // kx) end as bx, avg(v) as v from k group by all),
i as (select image_id, case when avg(v) > 0 then stddev_pop(v) / avg(v) else 'inf'::double end as cv from b group by 1),
f as (select image_id, m, sd, p01, p99, lo, hi, sharp, w, h, cv, least(w, h) < 10 as f1, sharp < 1454.422186 as f2, cv > 0.350527 as f3, lo + hi > 0.010814 as f4, p99 - p01 < 172 as f5 from q join s using (image_id) join i using (image_id))
select image_id, round(m, 6) as mean_intensity, round(sd, 6) as std_intensity, round(lo, 6) as low_clip_ratio, round(hi, 6) as high_clip_ratio, round(sharp, 6) as sharpness, w as image_width, h as image_height, round(cv, 6) as illum_cv, round(p01, 6) as p01, round(p99, 6) as p99, round(p99 - p01, 6) as dynamic_range, round(lo + hi, 6) as saturation_ratio,
f1 as flag_insufficient_dimensions, f2 as flag_low_sharpness, f3 as flag_high_illum_cv, f4 as flag_high_saturation, f5 as flag_low_dynamic_range, f1::int + f2::int + f3::int + f4::int + f5::int as flag_count, case when f1::int + f2::int + f3::int + f4::int + f5::int >= 2 then 'FAIL' when f1::int + f2::int + f3::int + f4::int + f5::int = 1 then 'REVIEW' else 'PASS' end as quality_status from f""",
    "pixel_flash": f"with {_LP} select f.image_id, count(*) as pixels, round(avg(f.lr - a.lr), 6) as dr, round(avg((f.lg - a.lg) * 0.9), 6) as dg, round(avg((f.lb - a.lb) * 1.1), 6) as db from lp f join lp a on a.image_id - 1 = f.image_id and a.x = f.x and a.y = f.y group by 1",
    "absorption_spectra": """with s as (select n_nationkey as chromophore, unnest([400, 500, 600, 700]) as wavelength from nation), a as (select s_suppkey as sample_id, wavelength, sum((wavelength % 7 + chromophore) / 10 * abs(s_acctbal) / 1000) as absorption from supplier join s on s_nationkey = chromophore group by all)
select sample_id, wavelength, round(absorption, 6) as absorption, round(exp(-(absorption / 100 + 0.01)), 6) as transmitted from a""",
}

# Files hold whole rows of 16 pixels only.
_WHOLE_ROWS = lambda sql: sql.replace(_PX, f"{_PX.replace('px as (', 'pa as (', 1)}, px as (select * from pa qualify count(*) over (partition by image_id, y) = 16)")
SQL |= {f"image_{a}": _WHOLE_ROWS(SQL[f"pixel_{b}"]) for a, b in (("features", "features"), ("regions", "regions"))}
SQL["image_quality"] = f"select * exclude (image_width, image_height) from ({_WHOLE_ROWS(SQL['pixel_quality'])})"
SQL["image_audit"] = f"select *, gray_mean between 15 and 240 as brightness_ok, gray_std >= 5 as contrast_ok, laplacian_variance >= 20 as blur_ok, saturated_fraction <= 0.25 as saturation_ok, null::varchar as quality_error from ({_WHOLE_ROWS(SQL['pixel_sharpness'])})"
