import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenframe.operators import column_quality as q
from lumenframe.operators import schema_drift as s
from lumenframe.plans import intake
from lumenframe.sources.chunks import column_profile, value_counts
from tests.conftest import rows


def test_counts_come_from_footers_dictionaries_and_pages(spark, tmp_path):
    t = pa.table({"load_id": pa.array([1, 1, 2, 2], pa.int32()), "v": ["a", "a", None, "b"], "w": pa.array([None] * 4, pa.string()), "z": ["x"] * 4, "h": [1, 2, 3, 4]})
    pq.write_table(t, tmp_path / "a.parquet", row_group_size=2, use_dictionary=["v"])
    pq.write_table(t.slice(0, 0), tmp_path / "empty.parquet")
    got = rows(value_counts(spark, str(tmp_path), ["load_id"], ["v", "w", "z", "gone"]).drop("source"))
    assert got == sorted([("1", "v", "a", 2), ("1", "w", None, 2), ("1", "z", "x", 2), ("1", "gone", None, 2), ("2", "v", None, 1), ("2", "v", "b", 1), ("2", "w", None, 2), ("2", "z", "x", 2), ("2", "gone", None, 2)], key=repr)
    sources = {(r["column_name"], r["source"]) for r in value_counts(spark, str(tmp_path), ["load_id"], ["v", "w", "z"]).collect()}
    assert ("w", "footer") in sources and ("z", "footer") in sources and ("v", "dictionary") in sources
    pq.write_table(t, tmp_path / "b.parquet", use_dictionary=False)
    assert ("v", "pages") in {(r["column_name"], r["source"]) for r in value_counts(spark, str(tmp_path / "b.parquet"), ["load_id"], ["v"]).collect()}


def test_footers_answer_and_only_other_chunks_are_read(spark, tmp_path):
    t = pa.table({"i": [3, None, 7, 1], "x": [1.5, 2.5, None, None], "s": ["a", "b" * 100, "c", None], "b": [True, False, None, True]})
    pq.write_table(t, tmp_path / "a.parquet", row_group_size=2)
    pq.write_table(t.select(["i"]), tmp_path / "b.parquet", write_statistics=False)
    got = {r["column_name"]: r for r in column_profile(spark, str(tmp_path), ["i", "x", "s", "b"]).collect()}
    assert (got["i"]["rows"], got["i"]["nulls"], got["i"]["low_number"], got["i"]["high_number"], got["i"]["distinct_values"]) == (8, 2, 1.0, 7.0, 3)
    assert (got["i"]["from_footers"], got["i"]["scanned"]) == (2, 1) and (got["x"]["scanned"], got["x"]["nulls"], got["x"]["high_number"]) == (0, 6, 2.5)
    assert (got["s"]["low_text"], got["s"]["high_text"], got["s"]["scanned"]) == ("a", "c", 1) and got["b"]["high_number"] == 1.0


def manifest(spark, loads):
    data = [(load, "S", "hemoglobin", v, "100.0", "10.0") for load, values in loads.items() for v in values]
    return spark.createDataFrame(data, "load_id int, site_code string, biomarker string, target_value string, working_distance_mm string, incidence_angle_deg string")


BOUNDS = [("target_value", "hemoglobin", 3.0, 25.0), ("working_distance_mm", None, 20.0, 600.0)]


@pytest.fixture
def found(spark, folder):
    def run(loads):
        d = folder(intake_manifest=manifest(spark, loads), column_bounds=spark.createDataFrame(BOUNDS, "column_name string, biomarker string, low_value double, high_value double"))
        return {(r["load_id"], r["finding"]) for r in intake.p5_found(spark, d).where("column_name = 'target_value'").collect()}

    return run


def test_findings(found):
    usual = [f"{10 + i / 10:.1f}" for i in range(50)]
    loads = {i: usual for i in range(1, 5)} | {5: usual[:30] + [None, "", "n/a", "-", "NaN"] * 4, 6: usual[:40] + ["1,2", "12 g", "~3", "１２", "1e3"], 7: usual[:40] + ["99", "-1", "0.1", "26", "+30"], 8: ["20.5"] * 30 + usual[:10]}
    assert found(loads) == {(5, "nulls"), (6, "pattern"), (7, "range"), (8, "shift"), (8, "constant")}


def test_missing_bounds_and_empty_loads(found):
    assert found({1: [None, " "], 2: ["1"], 3: ["x"]}) >= {(1, "nulls"), (3, "pattern")}


def test_empty_table(found):
    assert found({}) == set()


def test_others_match_brute_force_in_many_ranges(spark, folder, monkeypatch):
    import numpy as np

    monkeypatch.setattr(q, "PER_RANGE", 20)
    rng = np.random.default_rng(3)
    loads = {i: [None if rng.random() < 0.1 else f"{v:.{rng.integers(0, 3)}f}" for v in rng.normal(12, 6, rng.integers(1, 60))] for i in range(12)} | {20: [], 21: ["99"], 22: ["5", "5.0", "5.00"] * 9}
    d = folder(intake_manifest=manifest(spark, loads), column_bounds=spark.createDataFrame(BOUNDS, "column_name string, biomarker string, low_value double, high_value double"))
    got = {r["load_id"]: r for r in intake._profile(spark, d).where("column_name = 'target_value'").collect()}
    number = lambda v: [float(x) for x in v if x is not None and 3.0 <= float(x) <= 25.0]
    assert set(got) == {k for k, v in loads.items() if v}
    for k, r in got.items():
        for values, have in ((number(loads[k]), r["quartiles"]), ([x for j, v in loads.items() if j != k for x in number(v)], r["other_quartiles"])):
            assert have == (pytest.approx(np.quantile(values, [0.25, 0.5, 0.75])) if values else None)
        assert r["rows"] == len(loads[k]) and r["distinct_values"] == len({v for v in loads[k] if v is not None})
    assert got[22]["commonest"] == 27


def test_words_for_no_value(spark):
    c = spark.createDataFrame([(1, "S", None, "target_value", v, 1) for v in ("?", "--", " N/A ", "none", "ok", "0", None, " ")], "load_id int, site_code string, biomarker string, column_name string, value string, n long")
    got = {r["value"]: r["missing"] for r in q.classified(c, spark.createDataFrame(BOUNDS, "column_name string, biomarker string, low_value double, high_value double")).collect()}
    assert got == {"?": True, "--": True, " N/A ": True, "none": True, "ok": False, "0": False, None: True, " ": True}


FILES = {
    1: ['{"participant_uuid":"a","iso":100,"wb":"auto","x":null}', '{"participant_uuid":"b","iso":200,"wb":"locked"}', '{"participant_uuid":"c","iso":', "[1]", None],
    2: ['{"participantUuid":"a","iso":"100","battery":5,"bits":8}', '{"participantUuid":"b","iso":"200","battery":true,"bits":8.5}', '{"participantUuid":"b","iso":7,"battery":6,"bits":" "}'],
}


@pytest.fixture
def exports(spark, folder):
    from datetime import datetime

    data = [(10 * f + i, f, "feed", datetime(2024, 1, f), p) for f, lines in FILES.items() for i, p in enumerate(lines)]
    names = spark.createDataFrame([("participant_uuid",), ("iso",), ("white_balance_mode",), ("bit_depth",)], "field_name string")
    schema = "row_id long, file_id int, feed string, exported_at timestamp, payload string"
    return lambda keep=True: folder(export_rows=spark.createDataFrame(data if keep else [], schema), field_catalog=names)


def test_changes(spark, exports):
    assert rows(intake.p6_found(spark, exports())) == sorted([(2, "participant_uuid", "renamed"), (2, "iso", "retyped"), (2, "white_balance_mode", "removed"), (2, "battery", "added"), (2, "bit_depth", "added")], key=repr)


def test_union_table(spark, exports):
    d = exports()
    t = intake.p6_table(spark, d)
    assert dict(t.dtypes) == {"row_id": "bigint", "file_id": "bigint", "bit_depth": "double", "iso": "string", "participant_uuid": "string", "white_balance_mode": "string"}
    assert t.count() == 5 and t.where("row_id = 20").first()["bit_depth"] == 8.0
    assert [r["change_kind"] for r in intake.p6_log(spark, d).collect()] == ["added", "added", "retyped", "renamed", "removed"]


def test_no_files(spark, exports):
    d = exports(False)
    assert intake.p6_found(spark, d).count() == 0 and intake.p6_table(spark, d).count() == 0


def test_lattice():
    assert s.promoted(["long", "double"]) == "double" and s.promoted(["boolean", "long"]) == "text" and s.promoted(["nothing", "long"]) == "long" and s.promoted([]) == "nothing" and s.promoted(["object", "array"]) == "text"
    assert [s.kind_of(v) for v in (None, "", " ", True, 1, 2**70, 1.5, "x", {}, [])] == ["nothing", "nothing", "nothing", "boolean", "long", "double", "double", "text", "object", "array"]


def test_brute_force_on_the_small_table(spark, small):
    import json
    from collections import Counter, defaultdict

    from lumenframe.functions.field_names import Catalog
    from lumenframe.sources.tables import table

    cat = Catalog(intake.catalog(spark, small))
    kinds, names, order = defaultdict(Counter), defaultdict(Counter), {}
    for r in table(spark, small, "export_rows").collect():
        order[r["file_id"]] = (r["feed"], r["exported_at"], r["file_id"])
        try:
            d = json.loads(r["payload"])
        except ValueError:
            continue
        for k, v in d.items():
            if v is not None and not (isinstance(v, str) and not v.strip()):
                kinds[r["file_id"], cat.field(k)]["number" if type(v) in (int, float) else type(v).__name__] += 1
                names[r["file_id"], cat.field(k)][k] += 1
    want = set()
    files = sorted(order, key=order.get)
    for a, b in zip(files, files[1:], strict=False):
        if order[a][0] != order[b][0]:
            continue
        of = lambda f: {k for g, k in kinds if g == f}
        want |= {(b, k, "added") for k in of(b) - of(a)} | {(b, k, "removed") for k in of(a) - of(b)}
        for k in of(a) & of(b):
            top = lambda c: c.most_common(1)[0][0]
            want |= {(b, k, "renamed")} if top(names[a, k]) != top(names[b, k]) else set()
            want |= {(b, k, "retyped")} if top(kinds[a, k]) != top(kinds[b, k]) else set()
    assert set(map(tuple, intake.p6_found(spark, small).collect())) == want and want
