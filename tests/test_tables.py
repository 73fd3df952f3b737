import pytest
from pyspark.sql import functions as F

from lumenframe.operators import adapters as a
from lumenframe.operators import gates as g
from lumenframe.operators import relations as rel
from lumenframe.schema import CANONICAL, ColumnMapping
from tests.conftest import one, rows

GOOD = dict(patient_id="p1", image_id="i1", image_path="x.jpg", source_dataset="demo", biomarker="hemoglobin", target_value=12.0, target_unit="g/dL", target_source="lab", reference_method="cbc", reference_measurement_id="r1", reference_type="laboratory", roi_type="conjunctiva", roi_x0=10.0, roi_y0=10.0, roi_x1=50.0, roi_y1=50.0, image_width=100.0, image_height=100.0, device_model="A", illumination="flash", acquisition_id="a1", exposure_us=1000.0, iso=100.0, white_balance_mode="locked", working_distance_mm=100.0, incidence_angle_deg=5.0, image_format="jpg", bit_depth=8.0, raw_available=True, target_time_delta_min=1.0)


@pytest.fixture
def make(spark):
    from lumenframe.schema import CANONICAL_SCHEMA
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in CANONICAL_SCHEMA])
    return lambda *changes: spark.createDataFrame([tuple((GOOD | c)[k] for k in CANONICAL) for c in changes], schema)


def broken(df, rules):
    return [sorted(r["errors"]) for r in g.checked(df, rules).collect()]


def test_good_rows_pass_every_gate(make):
    df = make({})
    for rules in (g.canonical_rules(True), g.acquisition_rules(), g.physics_rules(True), g.target_rules("hemoglobin", "g/dL"), g.intake_rules("hemoglobin", "g/dL")):
        assert broken(df, rules) == [[]] and one(g.passed(df, rules))["passed"]
    assert not one(g.passed(df.where("false"), g.canonical_rules()))["passed"]


@pytest.mark.parametrize(
    ("rules", "change", "name"),
    [
        (g.canonical_rules, {"target_value": None}, "target_not_numeric"), (g.canonical_rules, {"target_value": float("inf")}, "target_not_finite"), (g.canonical_rules, {"target_value": -1.0}, "target_negative"), (g.canonical_rules, {"patient_id": " "}, "missing_patient_id"),
        (g.canonical_rules, {"biomarker": "zinc"}, "biomarker_unknown"), (g.canonical_rules, {"target_unit": "mg/dL"}, "unit_unexpected"), (g.canonical_rules, {"roi_type": "elbow"}, "roi_unsupported"), (g.canonical_rules, {"roi_x0": 10.5}, "roi_not_integer"), (g.canonical_rules, {"roi_x1": 500.0}, "roi_outside"), (g.canonical_rules, {"roi_x1": 12.0}, "roi_size"),
        (g.acquisition_rules, {"iso": None}, "missing_iso"), (g.acquisition_rules, {"iso": 0.0}, "iso_invalid"), (g.acquisition_rules, {"incidence_angle_deg": 91.0}, "incidence_angle_deg_invalid"), (g.acquisition_rules, {"white_balance_mode": " AWB "}, "white_balance_auto"), (g.acquisition_rules, {"illumination": "candle"}, "illumination_unknown"),
        (g.physics_rules, {"exposure_us": float("inf")}, "exposure_us_invalid"), (g.physics_rules, {"bit_depth": 7.5}, "bit_depth_invalid"), (g.physics_rules, {"white_balance_mode": None}, "white_balance_auto"), (g.target_rules, {"reference_type": "rumour"}, "reference_type_unsupported"), (g.target_rules, {"target_time_delta_min": -1.0}, "time_delta_invalid"), (g.target_rules, {"target_source": ""}, "missing_target_source"),
        (g.intake_rules, {"white_balance_mode": "automatic"}, "white_balance_auto"), (g.intake_rules, {"iso": -1.0}, "iso_invalid"), (g.intake_rules, {"roi_type": "tongue"}, "roi_unsupported"), (g.intake_rules, {"roi_x1": None}, "roi_invalid"), (g.intake_rules, {"illumination": None}, "illumination_unsupported"),
    ],
)
def test_rules(make, rules, change, name):
    assert name in broken(make(change), rules())[0]
    counts = {r["rule"]: r["n"] for r in g.verdict(make({}, change), rules()).collect()}
    assert counts[name] == 1


def test_exploratory_regions_warn_unless_strict(make):
    df = make({"roi_type": "tongue"})
    assert one(g.checked(df, g.canonical_rules()))["warnings"] == ["roi_exploratory"] and "roi_exploratory" in broken(df, g.canonical_rules(True))[0]


def test_zero_settings_pass_intake_only(make):
    df = make({"exposure_us": 0.0, "iso": 0.0})
    assert broken(df, g.intake_rules()) == [[]] and broken(df, g.acquisition_rules()) != [[]]


def test_reports(make, spark):
    r = one(g.target_report(make({}, {"image_id": "i2"})))
    assert (r["n_rows"], r["n_reference_measurements"], r["n_repeated_references"], r["valid"]) == (2, 1, 1, False)
    df = make({}).withColumn("dataset", F.lit("ext"))
    assert one(g.external_partition(df, make({"patient_id": "p9"}), "hemoglobin", "g/dL", "ext"))["valid"]
    assert not one(g.external_partition(df, make({}), "hemoglobin", "g/dL", "ext"))["valid"]
    assert not one(g.participant_preflight(spark.createDataFrame([("u", 12.0)], "patient_uuid string, cbc_hgb_g_dl double")))["passed"]
    v = one(g.video_preflight(spark.createDataFrame([("P1", "a.mp4", 10.2, "r1"), ("P2", "b.mp4", 12.1, "r2")], "patient_id string, video_path string, hemoglobin_gdl double, reference_measurement_id string")))
    assert (v["rows"], v["patients"], v["target_available"], v["provenance_complete"], v["passed"]) == (2, 2, 2, 2, False)


def test_overlaps(spark):
    df = spark.createDataFrame([("train", "p1", "a1"), ("test", "p1", "a2"), ("val", "p2", "a1"), ("test", None, None)], "part string, patient_id string, acquisition_id string")
    assert rows(rel.partition_overlaps(df, "part", ["patient_id", "acquisition_id"])) == [("acquisition_id", "train", "val", "a1"), ("patient_id", "test", "train", "p1")]
    assert sum(r["n"] for r in rel.overlap_counts(df, "part", ["patient_id", "acquisition_id"]).collect()) == 2
    with pytest.raises(ValueError):
        rel.require_disjoint(df, "part")
    rel.require_disjoint(df.where("part = 'train'"), "part", unique=True)


def test_split_keeps_patients_together(spark):
    df = spark.createDataFrame([(f"p{i // 2}", i) for i in range(40)], "patient_id string, n int")
    out = rel.patient_split(df)
    assert out.count() == 40 and out.select("partition").distinct().count() == 3
    rel.require_disjoint(out, "partition")
    assert rows(out) == rows(rel.patient_split(df.repartition(3)))
    for bad in (df.limit(4), df.withColumn("patient_id", F.lit(" ")), df.drop("patient_id")):
        with pytest.raises(ValueError):
            rel.patient_split(bad)


def test_unseen_device(spark):
    df = spark.createDataFrame([("p1", "A"), ("p1", "C"), ("p2", "A"), ("p3", "B")], "patient_id string, device_model string")
    assert rows(rel.unseen_device_split(df, "C").select("patient_id", "device_model", "partition")) == [("p1", "A", "excluded"), ("p1", "C", "test"), ("p2", "A", "train"), ("p3", "B", "train")]
    with pytest.raises(ValueError):
        rel.unseen_device_split(df.union(spark.createDataFrame([("p4", None)], df.schema)), "C")


def test_profiles(spark):
    df = spark.createDataFrame([("A", "p1", "a"), ("A", "p1", "b"), (None, None, "a")], "device_model string, patient_id string, acquisition_id string")
    assert rows(rel.device_distribution(df).select("device_model", "n")) == [("A", 2), (None, 1)]
    assert rows(rel.missingness(df))[0] == ("acquisition_id", 0.0)
    assert tuple(one(rel.leakage_audit(df))) == (3, 1, 1, 1, 0)
    assert rows(rel.duplicate_rows(df, "acquisition_id").select("acquisition_id")) == [("a",), ("a",)]
    assert tuple(one(rel.audit_gate(spark.createDataFrame([("x", True), ("y", None)], "name string, ok boolean")))) == (2, False)
    assert one(rel.audit_gate(spark.createDataFrame([], "name string, ok boolean")))["passed"] is False


def test_canonical(spark):
    raw = spark.createDataFrame([(" 0003 ", "/a/b/x.y.jpg", "12", "yes")], "pid string, file string, hb string, raw string")
    r = one(a.build_canonical(raw, ColumnMapping("pid", "file", "hb", raw_available="raw"), "demo", "Hemoglobin", "g/dL"))
    assert (r["patient_id"], r["image_id"], r["acquisition_id"], r["biomarker"], r["target_value"], r["raw_available"]) == ("0003", "0003_x.y", "0003_x.y", "hemoglobin", 12.0, True)
    with pytest.raises(Exception, match="not a boolean"):
        a.build_canonical(raw.withColumn("raw", F.lit("maybe")), ColumnMapping("pid", "file", "hb", raw_available="raw"), "d", "hemoglobin", "g/dL").collect()
    with pytest.raises(ValueError):
        ColumnMapping("YOUR_PATIENT", "file", "hb")
    assert a.normalized("  Blood (mg/dL) ") == "blood_mg_dl" and a.find_candidates(raw)["target_value"] == ["hb"]


def test_camera_values(spark):
    df = spark.createDataFrame([('{"a.b":{"result":8000000,"request":1}}',), ('{"a.b":{"request":7}}',), ('{"a.b":{"result":null,"request":7}}',), ('{"a.b":5}',), ("{}",), ("not json",), (None,)], "j string")
    assert [r[0] for r in df.select(a.camera_value(F.col("j"), ["x", "a.b"])).collect()] == ["8000000", "7", None, "5", None, None, None]
    words = spark.createDataFrame([("0",), ("1.0",), ("2",), ("OFF",), ("Single",), ("?",), (None,)], "w string")
    assert [r[0] for r in words.select(a.illumination_of_flash(F.col("w"))).collect()] == ["ambient", "flash", "flash", "ambient", "flash", None, None]


def test_participants(spark):
    df = spark.createDataFrame([("u1", "12", "11", "a.jpg", '{"android.sensor.exposureTime":{"result":8000000},"android.sensor.sensitivity":{"result":100}}', None), ("u2", None, "x", "b.jpg", None, "c.jpg"), ("u3", None, None, None, None, "d.jpg")], "patient_uuid string, cbc_hgb_g_dl string, survey_haemoglobin string, image_tongue string, camera_meta_tongue string, image_conjunctiva string")
    assert rows(a.adapt_participants(df).select("patient_id", "roi_type", "target_value", "exposure_us", "iso", "reference_type")) == [("u1", "tongue", 12.0, 8000.0, 100.0, "laboratory")]
    with pytest.raises(Exception, match="participant"):
        a.adapt_participants(df.withColumn("patient_uuid", F.lit(None).cast("string"))).collect()
    with pytest.raises(ValueError):
        a.adapt_participants(df, ["elbow"])


def test_neonatal(spark):
    df = spark.createDataFrame([("0003", "a.jpg", 12.2), ("0003", "b.jpg", 12.2)], "patient_id string, image_idx string, `blood(mg/dL)` double")
    here = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "name string")
    assert rows(a.neonatal_images(df, here).select("patient_id", "image_id", "target_value")) == [("0003", "a", 12.2), ("0003", "b", 12.2)]
    for bad, files in ((df.limit(1), here.where("name = 'b.jpg'")), (df.union(df), here), (df.withColumn("image_idx", F.lit("x/a.jpg")), here)):
        with pytest.raises(Exception, match="file"):
            a.neonatal_images(bad, files).collect()
    assert one(a.video_manifest(spark.createDataFrame([("p", "v.mp4", 10.0, "r")], "patient_id string, video_path string, hemoglobin_gdl double, reference_measurement_id string")))["reference_type"] == "unknown"
