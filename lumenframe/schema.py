"""The canonical table: one row an image."""

from __future__ import annotations

from dataclasses import fields, make_dataclass

from pyspark.sql import types as T

_TEXT = ("patient_id", "image_id", "image_path", "source_dataset", "biomarker", "target_unit", "target_source", "reference_method", "reference_measurement_id", "reference_type", "roi_type", "device_model", "illumination", "acquisition_id", "white_balance_mode", "image_format")
#: Column names in order (fixed values).
CANONICAL = (
    "patient_id", "image_id", "image_path", "source_dataset", "biomarker", "target_value", "target_unit", "target_source", "reference_method", "reference_measurement_id", "reference_type", "target_time_delta_min", "roi_type", "roi_x0", "roi_y0",
    "roi_x1", "roi_y1", "image_width", "image_height", "device_model", "illumination", "acquisition_id", "exposure_us", "iso", "white_balance_mode", "working_distance_mm", "incidence_angle_deg", "image_format", "bit_depth", "raw_available",
)
REQUIRED = ("patient_id", "image_id", "image_path", "source_dataset", "biomarker", "target_value", "target_unit")
#: Enumerations (fixed values).
UNITS = {"hemoglobin": "g/dL", "bilirubin": "mg/dL"}
ROIS = {"hemoglobin": ("conjunctiva", "nailbed"), "bilirubin": ("forehead", "sternum", "abdomen")}
EXPLORATORY_ROIS = ("tongue", "fingertip")
ILLUMINATION = ("flash", "ambient", "controlled_led", "reference")
REFERENCE_TYPES = ("laboratory", "validated_reference")

CANONICAL_SCHEMA = T.StructType([T.StructField(c, T.StringType() if c in _TEXT else T.BooleanType() if c == "raw_available" else T.DoubleType(), c not in REQUIRED) for c in CANONICAL])


class _Mapping:
    def __post_init__(self) -> None:
        for name in NAMED:
            value = getattr(self, name)
            if not value or not str(value).strip() or str(value).startswith("YOUR_"):
                raise ValueError(f"the mapping of {name} is missing or still a placeholder")

    @classmethod
    def from_yaml(cls, path: str):
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
        given = given.get("columns", given)
        return cls(**{f.name: given.get(f.name) for f in fields(cls)})


#: Canonical columns that a mapping must name, and those it gives itself.
NAMED, GIVEN = ("patient_id", "image_path", "target_value"), ("source_dataset", "biomarker", "target_unit")

#: Which raw column feeds which canonical one: three must be named, others may be.
ColumnMapping = make_dataclass("ColumnMapping", [*((c, str) for c in NAMED), *((c, str | None, None) for c in CANONICAL if c not in NAMED + GIVEN)], bases=(_Mapping,), frozen=True)
