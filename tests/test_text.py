from lumenframe.functions import field_names
from lumenframe.functions.text import fold
from tests.conftest import rows


def test_fold(spark):
    df = spark.createDataFrame([("  PT–００12 ",), ("l​ocked",), ("lосked",), ("",), (" ",), (None,), ("٠٣٠",)], "t string")
    assert [r[0] for r in df.select(fold("t")).collect()] == ["pt–0012", "locked", "locked", "", "", None, "030"]


def test_fold_of_plain_text_is_lower_case(spark):
    df = spark.createDataFrame([("A  b\tC",)], "t string")
    assert rows(df.select(fold("t"))) == [("a b c",)]


def test_names_mean_fields():
    fields = ["participant_uuid", "cbc_hgb_g_dl", "survey_haemoglobin", "device_model", "image_tongue", "camera_meta_tongue", "white_balance_mode", "iso", "exposure_us", "flash_mode", "session_id", "operator_id", "focus_state", "bit_depth"]
    c = field_names.Catalog(fields)
    pairs = {
        "participantUuid": "participant_uuid", "Patient UUID": "participant_uuid", "CBC_HGB": "cbc_hgb_g_dl", "surveyHb": "survey_haemoglobin", "survey_device_modal": "device_model", "img_tongue_path": "image_tongue", "meta.tongue.camera": "camera_meta_tongue", "wb": "white_balance_mode",
        "cam_Anemia_Tongue_iso": "iso", "sensitivity": "iso", "exp_us": "exposure_us", "cam_flash": "flash_mode", "visit_session": "session_id", "op": "operator_id", "af_state": "focus_state", "bits": "bit_depth", "battery_pct": "battery_pct", "lens_temp_c": "lens_temp_c", "": "",
    }
    assert {n: c.field(n) for n in pairs} == pairs
