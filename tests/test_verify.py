"""Verification of claims, ranks and quantiles, running sums, terms and overlaps, against brute force on small frames."""

import itertools
import random
import statistics as pystat

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import facts, text
from scriptorium.operators import match, order, statistics, verify

CLAIMS = [
    (1, 1, "numeric", "31.1%", "31.1"), (1, 2, "numeric", "12", "12"), (1, 3, "citation", "Smith et al. (2017)", "Smith2017"), (1, 4, "comparison", "outperforms Nacre by 2.3", "gt(Nacre,+2.3)"),
    (1, 5, "method_name", "LodestarNet", "LodestarNet"), (1, 6, "symbol", "k = 12", "k=12"), (2, 7, "numeric", "5", "5"), (3, 8, "other", "x", "x"), (2, 9, "numeric", None, None), (1, 10, None, "y", "y"),
]
TRANSLATIONS = [
    (10, 1, "Es erreicht 31,1 % mit k = 12 (Smith, 2017); LodestarNet 优于 Nacre。"), (11, 1, "It reaches 32.9%, see Jones (2018); lodestarnet is worse than Nacre, k = 14."), (12, 1, ""), (13, 1, None),
    (14, 2, "There are seven."), (15, 9, "No claims here."), (16, 3, "x"),
]


@pytest.fixture
def sides(spark):
    t = spark.createDataFrame(TRANSLATIONS, "translation_id int, unit_id int, tgt_plain string").withColumn("claim_type", F.lit("clash"))
    c = spark.createDataFrame(CLAIMS, "unit_id int, claim_id int, claim_type string, surface_form string, normalized string").withColumn("tgt_plain", F.lit("clash"))
    return t, c


def test_verified(sides):
    got = {(r.translation_id, r.claim_id): (r.drift, r.magnitude) for r in verify.verified(*sides).collect()}
    assert set(got) == {(t, c[1]) for t, u, _ in TRANSLATIONS for c in CLAIMS if c[0] == u}
    assert [got[10, c][0] for c in (1, 3, 4, 5, 6)] == ["verified"] * 5
    assert got[11, 4] == ("comparison_flip", 1.0) and got[11, 3][0] in ("citation_swap", "missing") and got[11, 6][0] == "symbol_drift"
    assert got[11, 1][0] == "numeric_drift" and got[11, 1][1] == pytest.approx(abs(32.9 - 31.1) / 31.1)
    assert all(got[t, c] == ("missing", 1.0) for t in (12, 13) for c in range(1, 7))
    assert got[14, 7] == ("missing", 1.0) and got[14, 9][0] == "missing"


def test_strict_then_rechecked(sides):
    t, c = sides
    strict = verify.verified(t, c, lenient=False)
    lenient = {(r.translation_id, r.claim_id) for r in verify.verified(t, c).where("drift = 'verified'").collect()}
    first = {(r.translation_id, r.claim_id) for r in strict.where("drift = 'verified'").collect()}
    failed = strict.where("drift <> 'verified' and (claim_type <> 'comparison' or claim_type is null)")
    saved = {(r.translation_id, r.claim_id) for r in verify.rechecked(failed, t, c).where("kept").collect()}
    assert first | saved == lenient
    h = {r.unit_id: r for r in verify.histogram(verify.verified(t, c).join(t.select("translation_id", "unit_id"), "translation_id"), ["unit_id"]).collect()}
    assert h[1].claims == 4 * 7 and h[1].n_partial == 0 and h[2].fps_symbol is None and h[2].n_missing == 2
    assert verify.verified(t.limit(0), c).count() == 0 and verify.verified(t, c.limit(0)).count() == 0


def test_forms(spark):
    d = spark.createDataFrame([("31.1%",), ("-2 K",), ("5×10⁻³",), ("3×10^4",), ("none",), (None,), ("",)], "s string")
    got = [tuple(r[0]) for r in d.select(facts.numeric(F.col("s"))).collect()]
    assert got[0] == ("31.1", "%", 1) and got[1] == ("-2", "K", 0) and got[3] == ("3", "×10^4", 0) and got[4] == ("none", None, None) and got[5] == (None, None, None)
    w = spark.createDataFrame([("is better than X",), ("no order",), ("A低于B",), ("A est inférieur à B",), ("x = y",), (None,)], "s string")
    assert [r[0] for r in w.select(facts.stated_order(F.col("s"))).collect()] == [">", "?", "<", "<", "=", "?"]
    t = spark.createDataFrame([("numeric", "31.1%"), ("citation", "Smith (2017)"), ("citation", "[12]"), ("comparison", "outperforms X"), ("symbol", "k = 3"), ("method_name", "Net"), ("numeric", "none"), (None, "x")], "k string, s string")
    assert [r[0] for r in t.select(facts.trapped(F.col("k"), F.col("s"))).collect()] == ["310.1%", "Smith (2018)", "[13]", "underperforms X", "k = 30", "Net2", "none", "x"]


def test_quantiles_like_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0.5, 0.5, rng.random(), rng.randrange(5) * 1.0])) for k in ("a", "a", "b", None) for _ in range(300)] + [("one", 3.0), ("none", None)]
    d = spark.createDataFrame(rows, "k string, x double").withColumn("value", F.lit(1)).repartition(5)
    got = {r.k: r for r in statistics.quantiles(d, ["k"], "x", {"m": 0.5, "p": 0.1}).collect()}
    near = {r.k: r.p for r in statistics.quantiles(d, ["k"], "x", {"p": 0.1}, nearest=True).collect()}
    for key in ("a", "b", None, "one"):
        v = sorted(x for k, x in rows if k == key and x is not None)
        at = 0.1 * (len(v) - 1)
        low = int(at)
        want = v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)
        assert got[key].n == len(v) and got[key].m == pytest.approx(pystat.median(v)) and got[key].p == pytest.approx(want) and near[key] == v[round(at)]
    assert got["none"].n == 0 and got["none"].m is None
    ranks = {(r.k, r.x): r.rank_x for r in statistics.with_ranks(d, ["k"], ["x"]).collect()}
    v = sorted(x for k, x in rows if k is None and x is not None)
    assert all(ranks[None, x] == pystat.mean([i + 1 for i, y in enumerate(v) if y == x]) for x in set(v)) and ranks[None, None] is None


def test_running_and_neighbours_by_blocks(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, 1, 5]), rng.choice([None, f"t{i}"])) for k in (1, 2, None) for i in range(50)]
    d = spark.createDataFrame([r for r in rows if r[0] is not None], "k int, i int, n int, t string")
    block = F.floor(F.col("i") / 7)
    got = {(r.k, r.i): r.running for r in order.running(d, ["k"], [F.asc("i")], F.col("n"), block).collect()}
    assert all(got[k, i] == sum(x[2] or 0 for x in rows if x[0] == k and x[1] <= i) for k, i, _, _ in rows if k is not None)
    a = {(r.k, r.i): (r.previous, r.following) for r in order.neighbours(d, ["k"], [F.asc("i")], "t", block).collect()}
    b = {(r.k, r.i): (r.previous, r.following) for r in order.neighbours(d, ["k"], [F.asc("i")], "t").collect()}
    assert a == b
    assert {(r.k, r.i) for r in order.within_cap(d, ["k"], [F.asc("i")], F.col("n"), 40, block).collect()} == {(r.k, r.i) for r in order.within_cap(d, ["k"], [F.asc("i")], F.col("n"), 40).collect()}


@pytest.mark.parametrize("sent", [10, 0])
def test_terms_by_tree_and_by_join(spark, monkeypatch, sent):
    monkeypatch.setattr(match, "SENT_TERMS", sent)
    texts = [(1, "The noise level of a CNN is low."), (2, "the NOISE-level; cnn"), (3, "déjà vu, noise"), (4, None), (5, "")]
    terms = ["noise level", "CNN", "Déjà vu", "level", " ", "absent term"]
    got = {(r.id, r.term) for r in match.words_in_text(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(x,) for x in terms], "term string"), "term").collect()}
    assert got == {(1, "noise level"), (1, "CNN"), (1, "level"), (2, "noise level"), (2, "level"), (3, "Déjà vu")}


def test_terms_in_scripts_without_spaces(spark):
    texts = spark.createDataFrame([(1, "探测器的噪声水平较低"), (2, "ตัวตรวจจับขึ้นกับแคช")], "id int, t string")
    got = {(r.id, r.term) for r in match.words_in_text(texts, "id", "t", spark.createDataFrame([("噪声水平",), ("แคช",)], "term string"), "term").collect()}
    assert got == {(1, "噪声水平"), (2, "แคช")}


def test_overlaps_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.sample("abcdefghij", rng.randrange(0, 6)) + ["hot"]) for i in range(60)]
    got = {(r.id_a, r.id_b) for r in match.overlapping(spark.createDataFrame(rows, "id int, w array<string>"), "id", "w", 3).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if len(set(a) & set(b)) >= 3}


def test_tree(spark):
    d = spark.createDataFrame([(1, None, 3), (2, 1, 0), (3, 2, 5), (4, 99, 0), (5, None, 1)], "id int, up int, ord int")
    assert {(r.id, r.level, r.path) for r in match.tree(d, "id", "up", "ord").collect()} == {(1, 0, "3"), (2, 1, "3.0"), (3, 2, "3.0.5"), (5, 0, "1")}
    assert match.tree(d.limit(0), "id", "up", "ord").count() == 0


def test_banks(spark):
    t = spark.createDataFrame([("Net",), ("CNN",), ("new",), (None,)], "term string")
    a = match.bank(spark.createDataFrame([("net", "R1", 2), ("NET", "R0", 1), (None, "x", 0)], "k string, v string, o int"), "k", "v", [F.asc("o")])
    b = match.bank(spark.createDataFrame([("net", "R9", 1), ("cnn", "R8", 1)], "k string, v string, o int"), "k", "v", [F.asc("o")])
    got = {r.term: (r.rendering, r.grounded_in) for r in match.grounded(t, "term", [a, b]).collect()}
    assert got == {"Net": ("R0", 1), "CNN": (None, 0), "new": (None, 0), None: (None, 0)}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 200])
def test_inversions(n):
    rng = random.Random(n)
    x = [rng.randrange(50) for _ in range(n)]
    assert statistics.inversions(statistics.np.array(x, int)) == sum(a > b for a, b in itertools.combinations(x, 2))


def test_small_text_functions(spark):
    d = spark.createDataFrame([("Sure:\n```json\n{\"a\": \"x\"}\n```", "[[1, \"t\"], [\"2\", \"u\"], [\"z\", \"no\"], [3]]", "gpt-x-2024-05-13", "arXiv:1234.5v12", "zh"), ("none", "broken", "m", "1", "xx"), (None, None, None, None, None)], "a string, p string, m string, i string, l string")
    rows = d.select(text.json_field(F.col("a"), "a"), text.id_pairs(F.col("p")), text.base_name(F.col("m")), text.plain_id(F.col("i")), text.language_name(F.col("l"))).collect()
    assert rows[0][0] == "x" and [tuple(x) for x in rows[0][1]] == [(1, "t"), (2, "u")] and rows[0][2:] == ("gpt-x", "1234.5", "Chinese")
    assert rows[1][0] is None and rows[1][1] == [] and rows[1][4] == "xx" and rows[2][0] is None and rows[2][1] == []
    tex = spark.createDataFrame([("\\begin{document}\nA \\cite{x} b.\n\n\\section{S}\n\nNo structure.\n\nB $y$.\n\\begin{thebibliography}\n\nC \\cite{z}",)], "t string")
    p = tex.select(F.explode(text.paragraphs(F.col("t"))).alias("p")).where(text.has_structure(F.col("p"))).collect()
    assert [r.p for r in p] == ["A \\cite{x} b.", "B $y$."]
