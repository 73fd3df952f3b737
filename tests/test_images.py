import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import pixels as px
from lumenframe.sources import files
from tests.conftest import one, rows


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def table(spark):
    def make(rgb, name="i"):
        h, w, _ = rgb.shape
        return spark.createDataFrame([(name, y, x, *map(int, rgb[y, x])) for y in range(h) for x in range(w)], "image_id string, y int, x int, r int, g int, b int")

    return make


def linear(x):
    x = np.clip(x / 255.0, 0, 1)
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


def test_constant_region(table):
    rgb = np.full((10, 10, 3), 128)
    rgb[0, 0] = (255, 100, 100)
    r = one(px.valid_region(table(rgb)))
    assert (r["valid_fraction"], r["saturated_fraction"], r["status"]) == (0.99, 0.01, "PASS")
    g = one(px.valid_region(table(np.full((4, 4, 3), 128)), (2.0, 1.0, 0.5), "bench"))
    assert g["mean_r"] == pytest.approx(2 * g["mean_g"]) and g["mean_b"] == pytest.approx(g["mean_g"] / 2)


def test_region_fails_closed(table):
    half = np.full((4, 4, 3), 128)
    half[:2] = 255
    r = one(px.valid_region(table(half), least=0.60))
    assert r["status"] == "FAIL" and r["mean_r"] is None
    with pytest.raises(ValueError):
        px.valid_region(table(half), (2.0, 1.0, 0.5))
    with pytest.raises(Exception, match="between 0 and 255"):
        px.valid_region(table(np.full((2, 2, 3), 300))).collect()


def test_features_match_numpy(table):
    rgb = np.random.default_rng(0).integers(0, 256, (6, 5, 3))
    r = one(px.features(table(rgb), {"r": 180, "g": 180, "b": 180}))
    lin = linear(rgb.astype(float)).reshape(-1, 3)
    for i, c in enumerate("rgb"):
        assert r[f"linear_{c}_mean"] == pytest.approx(lin[:, i].mean()) and r[f"linear_{c}_std"] == pytest.approx(lin[:, i].std())
    assert r["r_over_g"] == pytest.approx(lin[:, 0].mean() / lin[:, 1].mean()) and r["chrom_r_mean"] == pytest.approx((lin[:, 0] / lin.sum(1)).mean())
    assert one(px.features(table(np.full((3, 3, 3), 120)), {"r": 180, "g": 180, "b": 180}))["relative_od_r_mean"] > 0


def test_sharpness_matches_numpy(table):
    rgb = np.random.default_rng(1).integers(0, 256, (7, 9, 3))
    v = (19595 * rgb[..., 0] + 38470 * rgb[..., 1] + 7471 * rgb[..., 2] + 32768) >> 16
    p = np.pad(v, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * v
    r = one(px.sharpness(table(rgb)))
    assert r["laplacian_variance"] == pytest.approx(lap.var()) and r["gray_std"] == pytest.approx(v.std()) and r["dark_fraction"] == pytest.approx((v <= 10).mean())


def test_quality_matches_numpy(table):
    rgb = np.random.default_rng(2).integers(0, 256, (23, 17, 3))
    v = (19595 * rgb[..., 0] + 38470 * rgb[..., 1] + 7471 * rgb[..., 2] + 32768) >> 16
    means = [b.mean() for row in np.array_split(v, 10, axis=0) for b in np.array_split(row, 10, axis=1)]
    r = one(px.assessed(table(rgb)))
    assert r["illum_cv"] == pytest.approx(np.std(means) / np.mean(means)) and (r["p01"], r["p99"]) == pytest.approx(tuple(np.percentile(rgb, [1, 99]))) and r["sharpness"] == pytest.approx(v.var())
    black = one(px.assessed(table(np.zeros((20, 20, 3), int))))
    assert black["flag_count"] == 4 and black["quality_status"] == "FAIL"
    for shape in ((5, 5, 3), (8, 20, 3)):
        small = one(px.assessed(table(np.full(shape, 120))))
        assert small["flag_insufficient_dimensions"] and small["quality_status"] == "FAIL"


def test_flash_minus_ambient(table):
    a, b = table(np.full((2, 2, 3), 200)), table(np.full((2, 2, 3), 100))
    r = px.lit_minus_ambient(b, a, (2.0, 1.0, 1.0)).first()
    d = float(linear(np.array(100.0)) - linear(np.array(200.0)))
    assert (r["dr"], r["dg"]) == pytest.approx((2 * d, d))


def test_small_matrices(spark):
    r = px.identifiability(np.ones((3, 4)))
    assert not r["full_column_rank"] and r["parameters"] == 4
    s = spark.createDataFrame([("h", 500, 2.0), ("b", 500, 3.0)], "chromophore string, wavelength int, extinction double")
    c = spark.createDataFrame([("x", "h", 0.5), ("x", "b", 1.0)], "sample_id string, chromophore string, concentration double")
    assert rows(px.absorption(s, c)) == [("x", 500, 4.0)]
    with pytest.raises(Exception, match="negative"):
        px.absorption(s, c.withColumn("concentration", F.lit(-1.0))).collect()


def test_files_and_images(spark, tmp_path):
    rgb = np.random.default_rng(3).integers(0, 256, (12, 11, 3))
    png(tmp_path / "a.png", rgb)
    png(tmp_path / "b.PNG", rgb)
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    assert files.list_images(spark, str(tmp_path)).count() == 3
    meta = spark.createDataFrame([("a.png",), ("b.PNG",), ("bad.jpg",), ("gone.png",)], "image_path string")
    inv = {r["image_path"]: r for r in files.inventory(spark, meta, str(tmp_path)).collect()}
    assert inv["a.png"]["sha256"] == inv["b.PNG"]["sha256"] and (inv["a.png"]["width"], inv["a.png"]["height"]) == (11, 12)
    assert (inv["bad.jpg"]["exists"], inv["bad.jpg"]["readable"], inv["bad.jpg"]["sha256"], inv["gone.png"]["exists"]) == (True, False, None, False)
    got = files.pixels(files.read_images(spark, str(tmp_path / "a.png"))).orderBy("y", "x").collect()
    assert [(r["r"], r["g"], r["b"]) for r in got] == [tuple(map(int, p)) for p in rgb.reshape(-1, 3)]


def test_videos_without_decoder(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"abc")
    (tmp_path / "w.mp4").write_bytes(b"abc")
    m = spark.createDataFrame([(0, "v.mp4"), (1, "w.mp4"), (2, "gone.mp4")], "row_id long, video_path string")
    got = {r["row_id"]: r for r in files.inspect_videos(spark, m, str(tmp_path)).collect()}
    assert got[1]["duplicate_of"] == 0 and got[0]["duplicate_of"] is None and not got[2]["exists"] and got[2]["error"] == "video not found" and not got[0]["readable"]


def test_tables_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("patient_id,v\n0003,1\n")
    (tmp_path / "a.json").write_text('[{"v": 1}, {"v": 2}]')
    (tmp_path / "a.jsonl").write_text('{"v": 1}\n{"v": 2}\n')
    assert files.load_table(spark, str(tmp_path / "a.csv"), texts=["patient_id"]).first()["patient_id"] == "0003"
    assert files.load_table(spark, str(tmp_path / "a.json")).count() == files.load_table(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(ValueError):
        files.load_table(spark, str(tmp_path / "a.xls"))
    assert files.from_arrays(spark, y=[1.0, 2.0], p=[1.0, 2.0]).count() == 2
    with pytest.raises(ValueError):
        files.from_arrays(spark, y=[1.0], p=[])


def test_images_match_pixels(spark, tmp_path):
    from lumenframe.operators import images as im

    rng = np.random.default_rng(5)
    for name, shape in (("a", (13, 11)), ("b", (5, 30)), ("c", (1, 1))):
        png(tmp_path / f"{name}.png", rng.integers(0, 256, (*shape, 3)))
    (tmp_path / "broken.png").write_bytes(b"no image")
    read = files.read_images(spark, str(tmp_path))
    p = files.pixels(read).withColumnRenamed("image_id", "path")
    got = {r["path"]: r for r in im.measured(read, reference={"r": 180, "g": 180, "b": 180}).collect()}
    assert len(got) == 4 and [r["error"] for k, r in got.items() if k.endswith("broken.png")] == ["the image can't be decoded"]
    for what, want in (("features", px.features(p.withColumnRenamed("path", "image_id"), {"r": 180, "g": 180, "b": 180})), ("region", px.valid_region(p.withColumnRenamed("path", "image_id"))), ("sharpness", px.sharpness(p.withColumnRenamed("path", "image_id"))), ("quality", px.assessed(p.withColumnRenamed("path", "image_id")))):
        for r in want.collect():
            have = got[r["image_id"]][what].asDict()
            for k, v in r.asDict().items():
                if k in have:
                    assert have[k] == (pytest.approx(v) if isinstance(v, float) else v), (what, k)


def test_regions_and_their_errors(spark, tmp_path):
    from lumenframe.operators import images as im

    for name in "abcd":
        png(tmp_path / f"{name}.png", np.full((10, 10, 3), 128))
    read = files.read_images(spark, str(tmp_path))
    boxes = spark.createDataFrame([(f"{tmp_path}/a.png", 1.0, 2.0, 5.0, 6.0), (f"{tmp_path}/b.png", 1.0, 2.0, 11.0, 6.0), (f"{tmp_path}/c.png", 1.5, 2.0, 5.0, 6.0)], "path string, roi_x0 double, roi_y0 double, roi_x1 double, roi_y1 double")
    got = {r["path"][-5]: (r["error"], r["features"] and r["features"]["pixels"]) for r in im.measured(read, ("features",), boxes).collect()}
    assert got == {"a": (None, 16), "b": ("the region lies outside the image", None), "c": ("the region's corners aren't whole numbers", None), "d": ("the image has no region", None)}
    assert {r["features"]["pixels"] for r in im.measured(read, ("features",), centre=0.6).collect()} == {36}
    for bad in ({"high_saturation": 2.0}, {"low_sharpness": "x"}, {"low_sharpness": -1.0}):
        with pytest.raises(ValueError):
            im.QualityLimits(**bad)
    with pytest.raises(ValueError):
        im.RegionLimits(low=250, high=20)


def test_audit_fails_closed(spark, tmp_path):
    import json

    from lumenframe import cli

    rng = np.random.default_rng(6)
    root = tmp_path / "images"
    root.mkdir()
    for i in range(8):
        png(root / f"x{i}.png", rng.integers(40, 220, (20, 20, 3)))
    rows_ = ["patient_id,image_id,image_path,source_dataset,biomarker,target_value,target_unit,roi_type,roi_x0,roi_y0,roi_x1,roi_y1,image_width,image_height"] + [f"p{i},i{i},x{i}.png,d,hemoglobin,12.5,g/dL,nailbed,2,2,18,18,20,20" for i in range(8)]
    meta = tmp_path / "meta.csv"
    meta.write_text("\n".join(rows_))
    run = lambda command, *more: cli.main([command, "--output", str(tmp_path / command), "--report", str(tmp_path / "r.json"), *more])
    assert run("audit", "--input", str(meta), "--root", str(root)) == 0 and run("quality", "--root", str(root)) == 0
    assert run("features", "--input", str(meta), "--root", str(root)) == 0 and json.loads((tmp_path / "r.json").read_text()) == {"rows": 8, "failed": 0}
    (root / "x7.png").write_bytes(b"broken")
    assert run("quality", "--root", str(root)) == 1 and json.loads((tmp_path / "r.json").read_text())["error"] == 1
    assert run("audit", "--input", str(meta), "--root", str(root)) == 1
    checks = json.loads((tmp_path / "r.json").read_text())["checks"]
    assert not checks["all_images_readable"] and not checks["quality_extraction_complete"] and checks["patient_split_clean"]
    assert run("features", "--input", str(meta), "--root", str(root)) == 0 and json.loads((tmp_path / "r.json").read_text())["failed"] == 1
    assert run("optical-audit", "--input", str(meta), "--root", str(root)) == 1
