import pytest

from lumenframe.llm import identity as ident


def keys(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", function("v")).orderBy("i").collect()]


def test_patients(spark):
    same = ["PT-00000217", "pt_217", "PT0000217", "00000217-PT", "PT-OO000217", "Pt-00000２17", "Pt-000002l7", " pt_217_dup", "PT-00000217 (1)", "217.0", "00000217", "id=PT-00000217", "2024/PT-00000217", "PT–00000217", "PT-0000​0217", "PT-00000217#2", "subject pt_00000217", "PTー00000217", "PT-٠٠٠٠٠٢١٧"]
    assert set(keys(spark, ident.patient_key, same)) == {"p217"}
    assert keys(spark, ident.patient_key, ["QC-PHANTOM-01", "qc phantom 1", "QC_PHANTOM_02", None, "", "unknown", "PT-00000000", "PT-2170"]) == ["qc1", "qc1", "qc2", None, None, None, "p0", "p2170"]


def test_images_and_acquisitions(spark):
    assert set(keys(spark, ident.image_key, ["IMG-000000042", "img_42", "IMG000000042", "42.0", "raw_IMG-000000042", "images/IMG-000000042", " img_42.jpg", "IMG-000000042-v2", "img_42~2", "000000042-IMG", "2024-06/IMG-000000042"])) == {"i42"}
    assert set(keys(spark, ident.acquisition_key, ["AQ-034-0000132", "AQ0340000132", "aq_34_132", "034-0000132", "034-0000132-AQ", "AQ-34-132.0", "AQ-O34-OO00l32", "AQ-034-0000132/r1", "AQ0340000132 (2)", "2023/AQ-034-0000132", " aq_34_132*"])) == {"a34-132"}
    assert keys(spark, ident.acquisition_key, ["AQ-035-0000132", None, "AQ", "7"]) == ["a35-132", None, None, None]


def test_units(spark):
    same = ["Ferrune Duo 12 #00000100", "#00000100 Ferrune Duo 12", "ferrune_duo_12_#00000100", "Ferrune Duo 12/00000100", "Ferrune Duo 12 (#00000100)", "FERRUNE  DUO  12, unit 00000100", "Ferrune Duo 12 no. 100"]
    assert set(keys(spark, ident.unit_key, same)) == {"ferruneduo12#100"}
    assert keys(spark, ident.unit_key, ["Ferrune Duo 12", "UNKNOWN", "-", "", None, "Ferrune P4 #00000100"]) == [None, None, None, None, None, "ferrunep4#100"]


def test_digests_and_places(spark):
    d = "5410afa97c76926b5e4b13fb9f0953723d91f5ff36f04ef73a21e82596d74f35"
    assert set(keys(spark, ident.digest_key, [d, d.upper(), f"sha256:{d}", f"0x{d}", f"{d} ", "-".join(d[i : i + 8] for i in range(0, 64, 8))])) == {d}
    assert keys(spark, ident.digest_key, [ident.EMPTY_DIGEST.upper(), None, "", "abc", d[:-1]]) == [None] * 5
    place = "field_hemo/site08/PT-00000060/2024-01-22/IMG_0006.jpg"
    same = [f"/data/intake/{place}", f"file:///data/intake/{place}", "D:\\intake\\" + place.replace("/", "\\"), f"bucket://raw-images/{place}", place, f"/mnt/vol2/intake/{place}?rev=2", "/data/intake/field%5Fhemo/site08/PT%2D00000060/2024%2D01%2D22/IMG%5F0006.jpg", "/x/Field_Hemo/Site 8/pt_60/20240122/img-0006 (1).jpeg", "/x/./field_hemo/site08//PT-00000060/tmp/../2024_01_22/IMG_0006_edited.webp", "/x/ field_hemo/site08/PT-00000060/../PT-00000060/2024-01-22/IMG_0006.jpg "]
    assert set(keys(spark, ident.path_key, same)) == {"fieldhemo|8|p60|20240122|6"}
    deep = place.replace("/", "/a/b/c/d/e/f/../../../../../../", 1)
    assert keys(spark, ident.path_key, [deep, "../../" + place, place.replace("/", "/x/../y/../z/../q/../r/../s/../", 1)]) == ["fieldhemo|8|p60|20240122|6"] * 3
    other = keys(spark, ident.path_key, [place.replace("0006", "0007"), place.replace("site08", "site09"), "a/b.jpg", None, "", "%zz/" + place])
    assert other[0] != "fieldhemo|8|p60|20240122|6" and other[1].split("|")[1] == "9" and other[2:5] == [None, None, None] and other[5] == "fieldhemo|8|p60|20240122|6"


@pytest.mark.parametrize("name", ["p1_found", "p1_counts", "p1_records", "p2_found", "p2_batches", "p4_found"])
def test_sql_agrees(spark, small, duck, queries, name):
    from lumenframe.llm.registry import SQL

    df = queries[name](spark, small)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want) and want
