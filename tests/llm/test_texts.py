import base64
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mail, mixing, packing, page_lines, page_spam, tokens
from tests.conftest import one, rows

HEAD = "From: A B <a@ward.example>\nSubject: x\nMIME-Version: 1.0\n"
PLAIN = HEAD + "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"
SENTENCES = "Could you send the parts order for batch 207 before the 14th?\nWe moved the lamp 33 mm to the left and the glare went away."
SALAD = "turbo drone led lamp turbo drone forehead led lamp buy online turbo drone led lamp forehead buy online turbo drone led lamp"
LINKS = "\n".join(f"cheap tripod http://shop{i}.example/p/{i}" for i in range(9))


def test_nested_parts_have_no_limit():
    text = "Content-Type: text/plain\n\nOwn words here."
    for i in range(300):
        text = f'Content-Type: multipart/mixed; boundary="b{i:04d}x"\n\n--b{i:04d}x\n{text}\n--b{i:04d}x--\n'
    assert mail.own_lines(text) == ["Own words here."]
    both = 'Content-Type: multipart/alternative; boundary="q"\n\n--q\nContent-Type: text/plain\n\nplain\n--q\nContent-Type: text/html\n\n<p>rich</p>\n--q--\n'
    assert mail.own_lines(both) == ["plain"]
    rich = both.replace("\nplain\n", "\n \n")
    mixed = f'Content-Type: multipart/mixed; boundary="m"\n\n--m\n{rich}\n--m\nContent-Type: text/plain\n\nafter\n--m--\n'
    assert mail.own_lines(mixed) == ["rich", "after"]


@pytest.mark.parametrize(
    ("message", "lines"),
    [
        (None, []), ("", []), ("just text", ["just text"]), (PLAIN + "Hi,\nall good.\n-- \nA B | Ward 4\n\nOn Mon, 6 Mar 2023, C D wrote:\n> old\n> text\n", ["Hi,", "all good."]),
        (PLAIN + "On Mon, 6 Mar 2023, C D wrote:\n\told\n\t\n\ttext\n\nnew below\n", ["new below"]), (PLAIN + "new\n-----Original Message-----\nFrom: x\nold\n", ["new"]), (PLAIN + "new\n***\nThis message is meant for the addressee alone and nobody else at all.\n", ["new"]),
        (HEAD + "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode("größer ist besser".encode()).decode()[:-4], ["größer ist besse"]), (HEAD + "Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\ngr=F6=\n=DFer", ["größer"]),
        (HEAD + 'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<html><head><style>x</style></head><body><p>Hi &amp; bye</p><!-- no --><blockquote>old</blockquote><br>on</body></html>\n--b\nContent-Type: text/plain; name="a.txt"\nContent-Disposition: attachment\n\nnever\n--b--\n', ["Hi & bye", "on"]),
        (HEAD + 'Content-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/plain\n\nonce\n--b\nContent-Type: text/html\n\n<p>once</p>\n--b--', ["once"]), ("From a@b Mon\n" + PLAIN + "x y", ["x y"]), (PLAIN + "El lunes estarÃ© aquÃ\xad", ["El lunes estaré aquí"]),
    ],
)
def test_own_lines(message, lines):
    assert mail.own_lines(message) == lines


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (SENTENCES.split("\n")[0], "sentence"), (SALAD, "open"), ("cheap tripod http://shop1.example/p/3", "link"), ("www.best-lens6.test", "link"), ("[buy online](http://x.test/)", "link"), ("#optics #wardlife #visit", "tag"), ("product:drops;brand:ring light;model:K41;tag:black", "tag"),
        ("2024-01-20 00:56 ERROR upload worker=3 timeout file=IMG-000708219", "record"), ("PT-00040024;IMG-000672206;12.6;g/dL", "record"), ("[x] phone B packed", "record"), ("Present: Sivo Lexaren, Drusim Talaquilvo", "record"), ("selfie stick Ostdale, skin scanner Griheim, iron tablets in Tammora", "open"), ("Kind regards,", "short"),
        ("推測するより、もう一度測り直したいと思います。", "sentence"), ("Пришлите, пожалуйста, форму согласия до пятницы. Курьер опоздал.", "sentence"),
    ],
)
def test_lines(text, kind):
    assert page_lines.line(text).kind == kind


def test_disguises_don_t_matter():
    plain = page_lines.words(page_lines.unspell("deluxe coffee pod"))
    for x in ("d.e.l.u.x.e. .c.o.f.f.e.e. .p.o.d", "d3lux3 c0ff33 p0d", "DELUXE COFFEE POD", "de​luxe coffee pod", "dеluxе cоffee pod"):
        assert page_lines.words(page_lines.unspell(x)) == plain


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, kind int, line_no int")


def cases(spark, texts):
    return {r["doc_id"] for r in page_spam.scores(documents(spark, texts)).where("is_case").collect()}


def test_cases(spark):
    texts = [PLAIN + x for x in (SENTENCES, SALAD, LINKS, SALAD, "See the report here:\nhttp://wiki.example/1\n" + SENTENCES, SENTENCES + "\n\nOn Mon, 6 Mar 2023, C D wrote:\n> " + SALAD, SALAD + "\n" + SALAD, "\n".join(["[x] tripod", "[ ] ring light packed"] * 5), "ok thanks")] + [None, "", "x" * 200_000]
    assert cases(spark, texts) == {1, 2, 3, 6}
    assert cases(spark, []) == set()


def test_pmi_matches_brute_force(spark):
    texts = [PLAIN + x for x in (SENTENCES, SALAD, SENTENCES.replace("lamp", "led lamp"))]
    n, a, b = Counter(), Counter(), Counter()
    for t in texts:
        for _, _, w, _ in page_lines.page(mail.own_lines(t)):
            for x, y in zip(w, w[1:], strict=False):
                n[x, y] += 1
                a[x] += 1
                b[y] += 1
    total = sum(n.values())
    got, mean = page_spam.associations(page_spam.lines(documents(spark, texts)))
    want = {k: log(c * total / (a[k[0]] * b[k[1]])) for k, c in n.items()}
    assert {(r["a"], r["b"]): r["pmi"] for r in got.collect()} == pytest.approx(want) and mean == pytest.approx(sum(c * want[k] for k, c in n.items()) / total)


def test_token_counts(spark):
    from pathlib import Path

    if not Path(tokens.VOCABULARY).exists():
        pytest.skip("the vocabulary isn't here")
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(documents(spark, ["hello world", "", None, "a <|endoftext|> b", "ab" * 50_000])).collect()}
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 3 and got[4] > 1000


def rule(sizes, capacity):
    """The packing rule, straight from its definition."""
    bins, where = [], []
    for s in sizes:
        count = Counter(g for g in bins if 0 < g < capacity)
        square = lambda c: sum(v * v for v in c.values())
        options = []
        for g in sorted({g for g in bins if s <= g < capacity}):
            c = count.copy()
            c[g] -= 1
            if g > s:
                c[g - s] += 1
            options.append((square(c), 0, g))
        c = count.copy()
        if capacity > s:
            c[capacity - s] += 1
        options.append((square(c), 1, capacity))
        _, new, g = min(options)
        if new:
            bins.append(capacity - s)
            where.append(len(bins) - 1)
        else:
            k = max(i for i, x in enumerate(bins) if x == g)
            bins[k] -= s
            where.append(k)
    return bins


def test_packing_follows_the_rule():
    rng = np.random.default_rng(0)
    for capacity in (10, 37):
        for _ in range(10):
            sizes = rng.integers(1, capacity + 1, 60)
            got = packing.sum_of_squares(sizes, capacity)
            used = np.bincount(got, weights=sizes)
            assert used.max() <= capacity and sorted(capacity - used) == sorted(rule(sizes.tolist(), capacity))
    assert list(packing.sum_of_squares(np.array([0, 5, 0]), 5)) == [0, 1, 0] and len(packing.sum_of_squares(np.array([], int), 5)) == 0


def test_packing_of_texts(spark):
    rng = np.random.default_rng(1)
    data = [(i, int(t)) for i, t in enumerate([*rng.integers(0, 700, 200), 1024, 512, 0])] + [(900, None)]
    sizes = spark.createDataFrame(data, "doc_id long, tokens long")
    kinds = spark.createDataFrame([("small", 512, "x"), ("large", 2048, "x")], "container_kind string, capacity_tokens int, tokens string")
    p = packing.packed(sizes, kinds).toPandas()
    for kind, capacity in (("small", 512), ("large", 2048)):
        k = p[p["container_kind"] == kind]
        assert k["tokens"].sum() == sum(t or 0 for _, t in data) and k.groupby("container_id")["tokens"].sum().max() <= capacity and set(k["doc_id"]) == {i for i, _ in data}
        whole = k.groupby("doc_id")["container_id"].count()
        assert all(whole[i] == max(1, -(-(t or 0) // capacity)) for i, t in data)
        assert k["tokens"].sum() / (k["container_id"].nunique() * capacity) > 0.9
    assert one(packing.fills(packing.packed(sizes, kinds)).agg(F.max("fill")))[0] <= 1
    assert packing.packed(sizes.where("false"), kinds).count() == 0 and packing.packed(sizes, kinds.where("false")).count() == 0


TARGETS = [("a", 0.5, 1, 7), ("b", 0.3, 2, 7), ("c", 0.2, 4, 7), ("none", 0.1, 3, 7)]


def test_mixing(spark):
    rng = np.random.default_rng(2)
    data = [(i, s, int(t)) for i, (s, t) in enumerate((s, t) for s, n in (("a", 600), ("b", 200), ("c", 40), ("d", 50), (None, 10)) for t in rng.integers(0, 400, n))]
    sizes = spark.createDataFrame(data, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int, tokens int")
    planned = mixing.plan(sizes, targets)
    units = {r["source"]: r["units"] / mixing.RESOLUTION for r in planned.collect()}
    most = {s: k for s, _, k, _ in TARGETS}
    assert set(units) == {"a", "b", "c"} and all(units[s] <= most[s] + 1e-6 for s in units) and any(abs(units[s] - most[s]) < 1e-6 for s in units)
    sel = mixing.drawn(sizes, planned).toPandas()
    uses = sel.groupby("doc_id")["copy"].max()
    source = {i: s for i, s, _ in data}
    assert not sel.duplicated(["doc_id", "copy"]).any() and all(np.floor(units[source[i]] + 1e-9) <= n <= np.ceil(units[source[i]] - 1e-9) for i, n in uses.items())
    for s in units:
        assert abs((sel["source"] == s).sum() - units[s] * sum(x == s for x in source.values())) <= 1
    got = {r["source"]: r for r in mixing.shares(planned, mixing.drawn(sizes, planned)).collect()}
    assert all(abs(got[s]["actual_share"] - share) < 0.03 for s, share, _, _ in TARGETS if s in got)
    assert rows(mixing.drawn(sizes.repartition(3), planned)) == rows(mixing.drawn(sizes, planned))
    assert mixing.drawn(sizes.where("false"), mixing.plan(sizes.where("false"), targets)).count() == 0


def test_equal_sizes_and_a_hot_source(spark):
    sizes = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("tokens"))
    targets = spark.createDataFrame([("a", 1.0, 3, 1)], "source string, target_share double, max_repeats int, tokens int")
    assert mixing.drawn(sizes, mixing.plan(sizes, targets)).count() == 900
