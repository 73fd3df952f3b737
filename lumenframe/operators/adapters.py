"""Raw tables mapped to the canonical one, and names looked up in them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import guarded, missing, number, stripped
from ..schema import CANONICAL, CANONICAL_SCHEMA, ColumnMapping

#: Candidate names of logical fields, in order of preference.
CANDIDATES = {
    "patient_id": ("patient_id", "patientid", "participant_id", "participantid", "subject_id", "subjectid", "subject", "participant"),
    "image_path": ("image_path", "imagepath", "image_file", "image_filename", "filepath", "file_path", "filename", "image"),
    "target_value": ("hb", "hemoglobin", "hemoglobin_value", "hgb", "tsb", "bilirubin", "total_serum_bilirubin"),
    "device_model": ("device", "device_model", "smartphone", "phone_model", "camera_model"),
    "illumination": ("illumination", "light_intensity", "ambient_light", "lighting", "light"),
}
#: Words of booleans, modalities, camera keys, and words of light.
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
MODALITIES = ("conjunctiva", "fingernails_open", "fingernails_closed", "tongue")
EXPOSURE_KEYS, ISO_KEYS, FLASH_KEYS = ("android.sensor.exposureTime",), ("android.sensor.sensitivity",), ("android.flash.mode",)
FLASH_WORDS = {
    "ambient": ("0", "0.0", "off", "false", "none", "flash_mode_off", "off_mode", "ambient", "no_flash", "noflash", "natural_light"),
    "flash": ("1", "1.0", "2", "2.0", "on", "true", "single", "torch", "flash", "flash_mode_single", "flash_mode_torch"),
}
LIGHT_WORDS = {"flash": ("flash",), "ambient": ("ambient", "no_flash", "noflash", "natural_light"), "controlled_led": ("controlled_led",), "reference": ("reference",)}


def normalized(name: str) -> str:
    return "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.strip().lower()).split())


def normalized_text(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def find_candidates(df: DataFrame) -> dict[str, list[str]]:
    """For each logical field the columns that may hold it, best first. Names only; nothing is read."""
    have = {normalized(c): c for c in df.columns}
    return {field: [have[n] for n in names if n in have] for field, names in CANDIDATES.items()}


def parsed_boolean(c: Column | str) -> Column:
    """Accepted words to a boolean; null is false, anything else fails."""
    w = F.lower(stripped(c))
    return F.when(w.isNull(), False).when(w.isin(*TRUE), True).when(w.isin(*FALSE), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), w)).cast("boolean"))


def file_stem(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def build_canonical(raw: DataFrame, mapping: ColumnMapping, source_dataset: str, biomarker: str, target_unit: str) -> DataFrame:
    """The canonical table in one projection. Without an image id it is patient and file name; without an acquisition id, the image id."""
    text = lambda name: stripped(F.col(f"`{name}`")) if name else F.lit(None).cast("string")
    value = lambda name: number(F.col(f"`{name}`")) if name else F.lit(None).cast("double")
    fixed = {"source_dataset": F.lit(source_dataset), "biomarker": F.lit(biomarker.lower()), "target_unit": F.lit(target_unit)}
    image = text(mapping.image_id) if mapping.image_id else F.concat_ws("_", text(mapping.patient_id), file_stem(text(mapping.image_path)))
    special = fixed | {
        "image_id": image,
        "acquisition_id": text(mapping.acquisition_id) if mapping.acquisition_id else image,
        "raw_available": parsed_boolean(F.col(f"`{mapping.raw_available}`")) if mapping.raw_available else F.lit(False),
    }
    numeric = {"target_value", "target_time_delta_min", "roi_x0", "roi_y0", "roi_x1", "roi_y1", "image_width", "image_height", "exposure_us", "iso", "working_distance_mm", "incidence_angle_deg", "bit_depth"}
    return raw.select(*((special[c] if c in special else (value if c in numeric else text)(getattr(mapping, c))).alias(c) for c in CANONICAL))


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exist, isn't null and isn't blank, as text."""
    found = [F.when(~missing(F.col(f"`{n}`")), F.col(f"`{n}`").cast("string")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def path_of(df: DataFrame, column: str) -> Column:
    """The path of an image column that holds a text or a struct with a path."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    c = F.col(f"`{column}`.path") if isinstance(df.schema[column].dataType, T.StructType) else F.col(f"`{column}`").cast("string")
    return F.nullif(stripped(c), F.lit(""))


def camera_value(payload: Column, keys: Sequence[str]) -> Column:
    """A setting from camera metadata in JSON: of the first key present, its result or, only where there is no result key, its request; plain values as they are."""
    parsed = F.from_json(payload.cast("string"), "map<string,string>")

    def one(key: str) -> Column:
        v = F.get(F.map_values(F.map_filter(parsed, lambda k, _: k == key)), F.lit(0))
        inner = F.from_json(v, "map<string,string>")
        has = F.array_contains(F.map_keys(inner), "result")
        chosen = F.when(v.startswith("{"), F.when(has, F.element_at(inner, "result")).otherwise(F.try_element_at(inner, F.lit("request")))).otherwise(v)
        return F.nullif(chosen, F.lit(""))

    return F.coalesce(*(one(k) for k in keys))


def _words(c: Column, table: Mapping[str, Sequence[str]]) -> Column:
    w = F.translate(F.lower(stripped(c)), "- ", "__")
    return F.coalesce(*(F.when(w.isin(*words), F.lit(name)) for name, words in table.items()))


def illumination_of_flash(c: Column) -> Column:
    """ambient or flash from a flash mode in words or numbers, else null."""
    return _words(c, FLASH_WORDS)


def explicit_illumination(c: Column) -> Column:
    return _words(c, LIGHT_WORDS)


def adapt_participants(df: DataFrame, modalities: Sequence[str] = MODALITIES, source: str = "participant_export") -> DataFrame:
    """One participant row to one canonical row for each image it has.

    The target is the first present of blood count, venous and reported value, whether or not it is a number; a row whose target isn't one is dropped. A missing participant fails.
    """
    if unknown := set(modalities) - set(MODALITIES):
        raise ValueError(f"unsupported modalities: {sorted(unknown)}")
    who = guarded(F.lit(1.0), {"a participant is missing": missing(first_present(df, "patient_uuid", "participant_uuid"))})
    cbc, venous, survey = first_present(df, "cbc_hgb_g_dl"), first_present(df, "haemoglobin_gdl"), first_present(df, "survey_haemoglobin")
    kind = F.when(cbc.isNotNull(), F.struct(cbc.alias("v"), F.lit("complete_blood_count").alias("method"), F.lit("laboratory").alias("type"))).when(venous.isNotNull(), F.struct(venous.alias("v"), F.lit("venous_blood_draw").alias("method"), F.lit("laboratory").alias("type"))).otherwise(F.struct(survey.alias("v"), F.lit("survey").alias("method"), F.lit("self_reported").alias("type")))
    each = []
    for m in modalities:
        camera = F.col(f"camera_meta_{m}").cast("string") if f"camera_meta_{m}" in df.columns else F.lit(None).cast("string")
        flat = lambda s, m=m: first_present(df, f"cam_{m}_{s}", f"cam_{m.title()}_{s}", f"cam_Anemia_{m.title()}_{s}")
        each.append(F.struct(F.lit(m).alias("modality"), path_of(df, f"image_{m}").alias("path"), F.coalesce(camera_value(camera, EXPOSURE_KEYS), flat("exposure_ns")).alias("exposure"), F.coalesce(camera_value(camera, ISO_KEYS), flat("iso")).alias("iso"), F.coalesce(camera_value(camera, FLASH_KEYS), flat("flash_mode")).alias("flash")))
    rows = df.select(who.alias("_ok"), stripped(first_present(df, "patient_uuid", "participant_uuid")).alias("patient_id"), first_present(df, "device_model", "survey_device_modal").alias("device_model"), kind.alias("target"), F.explode(F.array(*each)).alias("image"))
    rows = rows.where("_ok = 1 and image.path is not null").withColumn("target_value", number("target.v")).where("target_value is not null")
    made = {
        "patient_id": F.col("patient_id"), "image_id": F.concat_ws("_", "patient_id", "image.modality"), "image_path": F.col("image.path"), "source_dataset": F.lit(source), "biomarker": F.lit("hemoglobin"), "target_value": F.col("target_value"), "target_unit": F.lit("g/dL"),
        "target_source": F.lit(source), "reference_method": F.col("target.method"), "reference_measurement_id": F.concat_ws("_", "patient_id", F.lit("hb")), "reference_type": F.col("target.type"), "roi_type": F.when(F.col("image.modality").startswith("fingernails"), "nailbed").otherwise(F.col("image.modality")),
        "device_model": F.col("device_model"), "illumination": illumination_of_flash(F.col("image.flash")), "acquisition_id": F.concat_ws("_", "patient_id", "image.modality"), "exposure_us": number("image.exposure") / 1000, "iso": number("image.iso"), "raw_available": F.lit(False),
    }
    text = {f.name: f.dataType for f in CANONICAL_SCHEMA}
    return rows.select(*(made.get(c, F.lit(None)).cast(text[c]).alias(c) for c in CANONICAL))


def video_manifest(df: DataFrame) -> DataFrame:
    """A video manifest with its four columns checked; an incomplete row fails."""
    bad = missing("patient_id") | missing("video_path") | missing("reference_measurement_id") | number("hemoglobin_gdl").isNull()
    target = guarded(number("hemoglobin_gdl"), {"a manifest row is incomplete": bad})
    return df.select(stripped("patient_id").alias("patient_id"), stripped("video_path").alias("image_path"), F.lit("hemoglobin").alias("biomarker"), target.alias("target_value"), F.lit("g/dL").alias("target_unit"), stripped("reference_measurement_id").alias("reference_measurement_id"), F.lit("fingertip").alias("roi_type"), *(F.coalesce(first_present(df, c), F.lit("unknown")).alias(c) for c in ("target_source", "reference_method", "reference_type")))


def neonatal_images(df: DataFrame, files: DataFrame, source: str = "neonatal_images") -> DataFrame:
    """Bilirubin metadata joined to the files that are there: ``files`` has ``name``. Paths instead of names, missing or repeated files, and negative values fail. Leading zeros of ids stay, as ids are text."""
    name, value = stripped("image_idx"), number("`blood(mg/dL)`")
    once = df.groupBy(name.alias("name")).agg(F.count("*").alias("times"))
    rows = df.withColumn("name", name).join(once, "name").join(files.select("name").distinct().withColumn("there", F.lit(True)), "name", "left")
    rules = {"a file name is a path": F.col("name").rlike(r"[/\\]"), "a file is missing": F.col("there").isNull(), "a file is named twice": F.col("times") > 1, "a value is missing or negative": value.isNull() | (value < 0)}
    return rows.select(stripped("patient_id").alias("patient_id"), file_stem(F.col("name")).alias("image_id"), F.col("name").alias("image_path"), F.lit(source).alias("source_dataset"), F.lit("bilirubin").alias("biomarker"), guarded(value, rules).alias("target_value"), F.lit("mg/dL").alias("target_unit"), F.lit("unknown").alias("roi_type"))
