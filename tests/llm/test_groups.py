import numpy as np
import pytest

from lumenframe.llm import components as co
from lumenframe.llm.canonical_values import Trie, allowed, candidates, map_values
from lumenframe.llm.queries_groups import SHARES, p3_unmatched, p4_splits
from tests.conftest import rows

VOCABULARY = [(1, "wb", "locked", "awb locked|wb lock"), (2, "wb", "auto", "awb|unlocked"), (3, "wb", "cloudy_daylight", None), (4, "roi", "conjunctiva", "inner eyelid"), (5, "roi", "fingertip", "finger pad"), (6, "wb", "custom_kelvin", "kelvin")]


def vocabulary(spark, data=VOCABULARY):
    return spark.createDataFrame(data, "entry_id int, field_name string, entry_label string, also_called string")


@pytest.mark.parametrize(
    ("value", "entry"),
    [
        ("Locked", 1), ("lоcked", 1), ("loc​ked", 1), ("L0CK3D", 1), ("lcoked", 1), ("wb-lock", 1), ("whi: locked", 1), ("wb=locked", 1), ("1) locked", 1), ("-> locked", 1), ("mode awb locked", 1), ("set to locked", 1), ("locked (ok)", 1), ("locked / 2nd try", 1), ("locked, see notes", 1), ("locked - checked", 1), ("'LOCKED'", 1), ("[wb lock]?", 1), ("lckd", 1),
        ("unlocked", 2), ("UNLLCKED", 2), ("ARB", 2), ("clouodydaylight", 3), ("cloudy daylight 5/5", 3), ("kelvni", 6), ("", 0), ("x", 0), ("see protocol", 0), ("conjunctiva", 0), ("zyxwvutsr", 0), ("??", 0), ("x" * 100_000, 0),
    ],
)
def test_values(value, entry):
    t = Trie((p, e) for e, f, label, more in VOCABULARY if f == "wb" for p in (label, *(more or "").split("|")))
    assert t.nearest(value)[0] == entry


def test_abbreviations():
    t = Trie((p, e) for e, f, label, more in VOCABULARY if f == "roi" for p in (label, *(more or "").split("|")))
    assert [t.nearest(v)[0] for v in ("conj.", "f-tip", "c.", "fing.")] == [4, 5, 0, 5]


def osa(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


def test_trie_finds_all_entries_within_the_limit():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 8)))
    paths = [(word(), i) for i in range(60)]
    t = Trie(paths)
    for _ in range(60):
        v, k = word(), int(rng.integers(0, 4))
        want = {}
        for p, e in paths:
            if (x := osa(p, v)) <= k:
                want[e] = min(x, want.get(e, 9))
        assert t.within(v, k) == want
    assert [allowed(n) for n in (2, 3, 7, 12)] == [0, 1, 2, 3]


def test_a_tie_is_unmatched():
    assert Trie([("abcd", 1), ("abce", 2)]).nearest("abcf")[0] == 0 and Trie([("abcd", 1), ("abce", 1)]).nearest("abcf")[0] == 1


def test_table(spark):
    df = spark.createDataFrame([(1, "locked", "x", 1), (2, "Locked", None, 1), (3, None, "", 1), (4, " ", "​", 1), (5, "auto?", "CONJUNCTIVA", 1), (5, "auto?", "CONJUNCTIVA", 1)], "record_id long, wb string, roi string, entry_id int")
    want = [(1, "roi", "x", 0), (2, "wb", "Locked", 1), (5, "roi", "CONJUNCTIVA", 4), (5, "roi", "CONJUNCTIVA", 4), (5, "wb", "auto?", 2), (5, "wb", "auto?", 2)]
    assert rows(map_values(df, ["wb", "roi"], vocabulary(spark)).select("record_id", "field_name", "value", "entry_id")) == want
    assert {r["entry_id"] for r in map_values(df, ["wb", "roi"], vocabulary(spark, [])).collect()} == {0}
    assert map_values(df.where("false"), ["wb", "roi"], vocabulary(spark)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 20_000])
def test_answers_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr("lumenframe.llm.canonical_values.BLOCK", block)
    monkeypatch.setattr("lumenframe.llm.canonical_values.PART", 3)
    words = [(1, "wb", "abcd", None), (2, "wb", "abce", "abcx"), (3, "wb", "zebra crossing", "conj"), (4, "wb", "conjunctiva", None), (5, "wb", "locked", None), (6, "roi", "abcd", None)]
    texts = ["abcf", "abcf", "abcd", "abcdd", "ABCD", "abcf: locked", "zebra crosing", "conj.", "con.", None, " ", "nothing like it", "locked (abce)"]
    df = spark.createDataFrame([(i % 9, t, "abcdd", 1) for i, t in enumerate(texts)], "record_id long, wb string, roi string, block int")
    got = rows(map_values(df, ["wb", "roi"], vocabulary(spark, words)).select("record_id", "field_name", "value", "entry_id", "distance"))
    want = []
    for i, t in enumerate(texts):
        for f, v in (("wb", t), ("roi", "abcdd")):
            if v and v.strip() and (f, v) not in {("wb", "abcd"), ("roi", "abcd")}:
                trie = Trie((p, e) for e, g, label, more in words if g == f for p in (label, *(more or "").split("|")) if p)
                want.append((i % 9, f, v, *trie.nearest(v)))
    assert got == sorted(want, key=repr) and (0, "wb", "abcf", 0, 0) in got and (1, "wb", "abcf", 0, 0) in got
    near = rows(candidates(df.selectExpr("'wb' as field_name", "wb as value").where("value is not null"), vocabulary(spark, words)))
    assert [r[2:] for r in near if r[1] == "abcf"] == [(1, 1), (2, 1)] and not [r for r in near if r[1] == "abcd"]


def test_readings_have_no_limit():
    wrapped = "wb: " * 40 + "locked" + " *" * 30 + " (x)"
    assert Trie([("locked", 1)]).nearest(wrapped) == (1, 0)


def test_unmatched_report(spark, small):
    assert p3_unmatched(spark, small).where("value = 'locked'").count() == 0


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    edges = {"random": [tuple(map(int, e)) for e in rng.integers(0, 120, (90, 2))], "path": [(i, i + 1) for i in range(60)][::-1], "star": [(i, 500) for i in range(50)]}[shape]
    df = spark.createDataFrame(edges + edges[:3], "u long, v long")
    assert {r["node"]: r["root"] for r in co.components(df).collect()} == union_find(edges)


def test_no_edges(spark):
    assert co.components(spark.createDataFrame([(None, 1), (2, None)], "u long, v long")).count() == 0


def test_groups(spark):
    df = spark.createDataFrame([(5, "a", "x", 1), (3, "b", "x", 1), (9, "b", None, 1), (4, None, None, 1), (6, None, "y", 1), (7, "c", "y", 1), (7, "c", "y", 1)], "visit_id long, p string, u string, row_id int")
    got = rows(co.grouped(df, "visit_id", ["p", "u"]).distinct())
    assert got == [(3, 3), (4, 4), (5, 3), (6, 6), (7, 6), (9, 3)]
    assert co.grouped(df.where("false"), "visit_id", ["p", "u"]).count() == 0


def test_closest_subset():
    rng = np.random.default_rng(2)
    for _ in range(40):
        counts = {int(s): int(rng.integers(1, 4)) for s in rng.integers(1, 30, 4)}
        sums = {0}
        for s, n in counts.items():
            sums = {t + s * k for t in sums for k in range(n + 1)}
        target = int(rng.integers(0, sum(s * n for s, n in counts.items()) + 5))
        take = co.closest_subset(counts, target)
        assert all(0 <= take[s] <= counts[s] for s in counts)
        assert abs(sum(s * k for s, k in take.items()) - target) == min(abs(t - target) for t in sums)
    assert co.closest_subset({}, 5) == {}
    assert sum(s * k for s, k in co.closest_subset({1: 10**7, 10**6: 3}, 5 * 10**6).items()) == 5 * 10**6
    assert co.closest_subset({6 * 10**6: 1, 5 * 10**6: 2}, 10**7) == {6 * 10**6: 0, 5 * 10**6: 2}
    odd = co.closest_subset({6_000_001: 1, 5_000_001: 2, 999_983: 3}, 10**7)
    assert odd == {6_000_001: 0, 5_000_001: 2, 999_983: 0} or sum(s * k for s, k in odd.items()) == 6_000_001 + 3 * 999_983 or abs(sum(s * k for s, k in odd.items()) - 10**7) <= 2


def test_splits_close_together():
    counts = {7: 3, 5: 4, 3: 2}
    q = co.split_quotas(counts, SHARES)
    assert all(sum(q[k].get(s, 0) for k in q) == n for s, n in counts.items())
    assert {k: sum(s * n for s, n in q[k].items()) for k in ("validation", "test")} == {"validation": 7, "test": 7}


def test_splits(spark, small, queries):
    s = p4_splits(spark, small).toPandas()
    assert s["visit_id"].is_unique and (s.groupby("group_visit_id")["split"].nunique() == 1).all()
    share = s["split"].value_counts(normalize=True)
    assert all(abs(share[k] - v) < 0.02 for k, v in SHARES.items())


def test_no_groups(spark):
    assert co.assigned(spark.createDataFrame([], "row_id long, group_id long"), SHARES).count() == 0
