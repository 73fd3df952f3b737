import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import vector_cells as vc
from lumenframe.llm import winnow as w
from lumenframe.llm.queries_splits import p1_counts, p1_found, p2_found
from tests.conftest import rows

CAPTURES = "record_id long, split_name string, source_dataset string, patient_id string, image_id string, acquisition_id string, h int, side int, c0 int, place int"


def captures(spark, data):
    return spark.createDataFrame([(*r, 1, 1, 1, 1) for r in data], CAPTURES)


def test_winnowing_keeps_a_hash_of_every_window():
    g = np.array([[5, 3, 3, 9, 1, 7]], np.uint64)
    k = w.kept(g, np.ones_like(g, bool))[0]
    assert all(k[j] or k[j + 1] for j in range(5)) and not k[0]
    broken = np.array([[True, False, True, True, True, True]])
    assert list(w.kept(g, broken)[0][:3]) == [True, False, True]


def test_rolling_equals_hash_from_scratch():
    s = np.random.default_rng(0).integers(0, 2**32, (4, 8), dtype=np.uint64)
    r = w.rolling(s)
    for j in range(6):
        assert (r[:, j] == w.rolling(s[:, j : j + w.K])[:, 0]).all()


def brute(data):
    from itertools import product

    return sorted((min(a[0], b[0]), max(a[0], b[0])) for a, b in product(data, data) if a[1] == "train" and b[1] not in (None, "train") and sum(x is not None and x == y for x, y in zip(a[3:6], b[3:6], strict=True)) >= 2)


def test_pairs_match_brute_force(spark, folder):
    rng = np.random.default_rng(4)
    pick = lambda k, tag: None if rng.random() < 0.1 else f"{tag}-{rng.integers(1, k):05d}"
    data = [(i, ["train", "test", "validation", None][rng.integers(0, 4)], "s", pick(8, "PT"), pick(30, "IMG"), None if rng.random() < 0.1 else f"AQ-001-{rng.integers(1, 9):07d}") for i in range(300)]
    d = folder(captures=captures(spark, data))
    assert sorted(map(tuple, p1_found(spark, d).collect())) == brute(data) and brute(data)
    counts = p1_counts(spark, d).collect()
    assert sum(r["pairs"] for r in counts) == len(brute(data)) and sum(r["records"] for r in counts) == sum(r[1] not in (None, "train") for r in data)


def test_crowded_hashes_are_parted(spark, folder, monkeypatch):
    data = [(i, ["train", "test"][i % 2], "s", "QC-PHANTOM-01", "IMG-7", f"AQ-001-{i % 5:07d}") for i in range(120)] + [(500 + i, ["train", "test"][i % 2], "s", f"PT-{i // 2}", f"IMG-{i // 2}", None) for i in range(20)]
    d = folder(captures=captures(spark, data))
    monkeypatch.setattr(w, "PAIRS_A_TASK", 100)
    assert sorted(map(tuple, p1_found(spark, d).collect())) == brute(data)
    codes = w.coded(spark.createDataFrame([(i, i % 2 == 0, 1, 2, 3) for i in range(60)], "i long, s boolean, a int, b int, c int"), F.col("i"), F.col("s"), [F.col("a"), F.col("b"), F.col("c")])
    assert {r["g"] for r in w.crowded(codes, 60).collect()} == {3}


def test_the_longest_alignment_decides(spark):
    df = spark.createDataFrame([(1, True, "a", "b", "c"), (2, False, "c", "a", "b"), (3, False, "a", "b", "x"), (4, False, "b", "a", "c"), (5, False, None, "b", "c")], "i long, s boolean, x string, y string, z string")
    got = w.shared_records(df, F.col("i"), F.col("s"), [F.col("x"), F.col("y"), F.col("z")]).collect()
    assert sorted((r["record_id_b"], r["shared"], r["turn"]) for r in got) == [(2, 3, 1), (3, 2, 0), (5, 2, 0)] and all(r["seeds"] >= 1 for r in got)


def test_hot_identifiers_and_repeated_rows(spark, folder):
    data = [(i, "train" if i % 2 else "test", "s", "QC-PHANTOM-01", f"IMG-{i:06d}", None) for i in range(400)] + [(1000, "train", "s", "PT-1", "IMG-7", None), (1000, "train", "s", "PT-1", "IMG-7", None), (1001, "test", "s", "PT-1", "img_7", None)]
    assert rows(p1_found(spark, folder(captures=captures(spark, data)))) == [(1000, 1001)]


def test_all_null_and_empty(spark, folder):
    data = [(1, "train", None, None, None, None), (2, "test", None, None, None, None), (3, None, None, "PT-1", "IMG-1", None), (4, "train", None, "PT-1", "IMG-1", None)]
    assert rows(p1_found(spark, folder(captures=captures(spark, data)))) == []


def test_empty_captures(spark, folder):
    assert rows(p1_found(spark, folder(captures=captures(spark, [])))) == []


def evidence(spark, vectors):
    return spark.createDataFrame([(i, k, None if v is None else bytearray(v)) for i, k, v in vectors], "file_id long, kind byte, vec binary")


@pytest.fixture
def vectors():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (40, vc.DIM))
    return [(i, 0, bytes(base[rng.integers(0, 40)].astype(np.uint8))) for i in range(1, 201)] + [(201, 0, None)]


def exact(vectors, radius, upto=None):
    out = {}
    known = [(i, np.frombuffer(v, np.uint8).astype(float)) for i, _, v in vectors if v]
    for i, v in known:
        near = [j for j, u in known if j < i and (upto is None or j <= upto) and np.linalg.norm(u - v) <= radius]
        if near:
            out[i] = min(near)
    return out


@pytest.mark.parametrize(("share", "least"), [(0.0, 0), (0.5, 0), (1.0, 10_000)])
def test_replay_equals_brute_force(spark, vectors, tmp_path, share, least, monkeypatch):
    monkeypatch.setattr(vc, "MOST_SEGMENTS", 2)
    ev = evidence(spark, vectors).withColumn("batch_id", F.expr("file_id div 30"))
    sizes = ev.groupBy("batch_id").agg(F.count("*").alias("n"))
    index = vc.CellIndex(spark, str(tmp_path / "a"))
    assert {r["file_id"]: r["earliest"] for r in vc.replay(index, ev, sizes, share, least).collect()} == exact(vectors, 0)
    again = vc.CellIndex(spark, str(tmp_path / "a"))
    assert again.state == index.state and again.stored().count() == len({v for _, _, v in vectors if v})


def test_rounds():
    counts = [(b, 100) for b in range(50)]
    assert vc.rounds(counts, 0.0, 0) == {b: b for b in range(50)}
    assert 3 < max(vc.rounds(counts, 1.0, 0).values()) < 10 and max(vc.rounds(counts, 1.0, 1000).values()) == 3


def test_a_batch_reads_only_the_cells_it_opens(spark, vectors, tmp_path):
    index = vc.CellIndex(spark, str(tmp_path / "a"), expected=16 * vc.PER_CELL)
    index.append(index.representatives(evidence(spark, vectors)))
    few = evidence(spark, [(900 + i, k, v) for i, k, v in vectors[:2]])
    cells = {r["cell"] for r in vc.probes(few, index.cells, 0.0, index.ring_width).collect()}
    opened = index.stored(sorted(cells))
    read = [r[0] for r in opened.select(F.input_file_name()).distinct().collect()]
    assert 0 < len(read) < len(index.stored().inputFiles()) and {f.split("/cell=")[1].split("/")[0] for f in read} <= {str(c) for c in cells}
    assert "PartitionFilters: [cell" in opened._jdf.queryExecution().executedPlan().toString()  # other folders aren't opened
    assert {r["file_id"]: r["earliest"] for r in index.check(few).collect()} == {900 + i: min(j for j, _, u in vectors if u == v) for i, _, v in vectors[:2]}


def test_near_vectors_meet_within_the_radius(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(20, 230, (30, vc.DIM))
    vs = [(i + 1, 0, bytes(b.astype(np.uint8))) for i, b in enumerate(base)] + [(100 + i, 0, bytes((b + rng.integers(-4, 5, vc.DIM)).astype(np.uint8))) for i, b in enumerate(base)]
    index = vc.CellIndex(spark, str(tmp_path / "c"), radius=20.0)
    index.append(index.representatives(evidence(spark, vs)))
    want = exact(vs, 20.0)
    for small in (vc.SMALL, 0):
        monkeypatch.setattr(vc, "SMALL", small)
        got = {r["file_id"]: r["earliest"] for r in index.check(evidence(spark, vs), radius=20.0).collect()}
        assert got == want and len(got) == 30  # recall 1: the bounds leave no nearer match out


def test_repeats_by_digest_or_place(spark, folder):
    d1, d2 = "a" * 64, "b" * 64
    p = "/data/intake/field_hemo/site01/PT-00000001/2024-01-01/IMG_%04d.jpg"
    data = [(1, p % 1, d1), (2, p % 2, d1.upper()), (3, p % 1 + "?x", d2), (4, None, d2), (5, p % 5, None), (6, None, None), (7, "odd", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), (8, "odd", "0xe3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), (9, "", "")]
    d = folder(inventory=spark.createDataFrame([(*r, 1, "x") for r in data], "file_id long, image_path string, sha256 string, batch_id int, vec string"))
    assert rows(p2_found(spark, d)) == [(1, 2), (1, 3), (3, 4)]


def test_empty_inventory(spark, folder):
    assert rows(p2_found(spark, folder(inventory=spark.createDataFrame([], "file_id long, image_path string, sha256 string, batch_id int")))) == []


def test_repeats_of_batches_out_of_order(spark, tmp_path):
    """A smaller file that comes in a later round counts for those before it, too."""
    a, b = bytes(range(32)), bytes(range(32, 64))
    data = [(500, 0, a, 0), (600, 0, b, 0), (601, 0, b, 0), (100, 0, a, 1), (700, 0, a, 2), (50, 0, b, 2), (900, 0, None, 2)]
    ev = spark.createDataFrame([(i, k, None if v is None else bytearray(v), n) for i, k, v, n in data], "file_id long, kind byte, vec binary, batch_id int")
    sizes = ev.groupBy("batch_id").agg(F.count("*").alias("n"))
    for number, how in enumerate(((0.0, 0), (1.0, 10_000))):
        index = vc.CellIndex(spark, str(tmp_path / str(number)))
        assert rows(vc.replay(index, ev, sizes, *how)) == [(500, 100), (600, 50), (601, 50), (700, 100)]


def test_a_round_moves_its_vectors_once(spark, vectors, tmp_path):
    """Each round is one shuffle of its vectors and one of the index, and rows that don't repeat aren't moved to be joined in the end."""
    index = vc.CellIndex(spark, str(tmp_path / "a"))
    index.take_in(evidence(spark, vectors[:100]), str(tmp_path / "first"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = index.met(evidence(spark, vectors[100:]))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    many = spark.range(20_000).selectExpr("cast(0 as byte) as kind", "unhex(sha2(cast(id as string), 256)) as vec", "id as file_id")
    few = many.where("file_id % 400 = 0").select("kind", "vec")
    kept = vc._sifted(many, few)
    assert {r["file_id"] for r in kept.collect()} >= set(range(0, 20_000, 400)) and kept.count() < 60
