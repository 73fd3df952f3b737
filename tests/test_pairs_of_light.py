from lumenframe.operators import gates as g
from lumenframe.sources import sinks


def test_flash_and_ambient_settings(spark):
    names = [f"{s}_{c}" for s in ("flash", "ambient") for c in ("device_model", "exposure_us", "iso", "working_distance_mm", "incidence_angle_deg", "white_balance_mode", "roi_type", "bit_depth", "image_format")]
    good = ["A", "1", "2", None, None, "locked", "palm", "8", "jpg"]
    bad = ["A", "1", "3", "100", None, "auto", "palm", "8", "jpg"]
    df = spark.createDataFrame([(*good, *good), (*bad, *good), (*([None] * 9), *([None] * 9))], ", ".join(f"{n} string" for n in names))
    got = [sorted(r["errors"]) for r in g.checked(df, g.pair_rules()).select("errors").collect()]
    assert got[0] == [] and got[1] == ["iso_differs", "white_balance_auto", "white_balance_mode_differs", "working_distance_mm_differs"] and got[2] == ["device_model_differs", "exposure_us_differs", "iso_differs"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    sinks.write_csv(df, str(tmp_path / "c"), ["k"])
    sinks.write_records(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.report_dict(df.limit(1))["k"] == "a" and '"n": 1' in sinks.write_report({"n": 1}, str(tmp_path / "x" / "r.json"))
