"""Operators against brute force and defined edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import facts, text
from scriptorium.operators import contract, match, order, quality, review, statistics


def one(spark, col, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.collapse(F.col("s")), s="  a   b\t\nc ") == "a b c"
    assert one(spark, text.restore(text.protect(F.col("s"))), s="a\nb\tc\rd") == "a\nb\tc\rd"
    assert one(spark, text.protect(F.col("s")), s=None) is None
    assert one(spark, text.chunks(F.col("s"), 3), s="abcdefg") == ["abc", "def", "g"]
    assert one(spark, text.chunks(F.col("s"), 3), s="") == []
    assert one(spark, text.bucket_of(F.col("s")), s="fps<0.95 (0.80)") == "fps"
    assert one(spark, text.fenced(F.col("s")), s='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.latex_tokens(F.col("s")), s=r"see \cite{a} and $x$ but \$5") == [r"\cite{a}", "$x$"]
    assert one(spark, text.without_tokens(F.col("s")), s="a {{PT_ref_1}} b") == "a b"


@pytest.mark.parametrize(
    "surface,form,way,delta",
    [("outperforms BERT by 2.3", "gt(BERT,+2.3)", ">", 2.3), ("is worse than X-1", "lt(X-1)", "<", None), ("equals Y by -4", "eq(Y,-4)", "=", -4.0), ("beats it", "gt(it)", ">", None), ("nothing", "nothing", None, None)],
)
def test_comparison(spark, surface, form, way, delta):
    r = one(spark, facts.comparison(F.col("s")), s=surface)
    assert (r.form, r.direction, r.delta) == (form, way, delta)


def test_numeric_and_citation(spark):
    assert tuple(one(spark, facts.numeric(F.col("s")), s=" 12.50 % of")) == ("12.50", "%", 2)
    assert tuple(one(spark, facts.numeric(F.col("s")), s="many")) == ("many", None, None)
    assert one(spark, facts.citation(F.col("s")), s="Vaswani et al. (2017)").key == "Vaswani2017"
    assert one(spark, facts.citation(F.col("s")), s="[3, 14]").key == "ref:3,14"


@pytest.mark.parametrize(
    "kind,a,b,want",
    [("numeric", "10", "10", ("verified", 0.0)), ("numeric", "10", "15", ("numeric_drift", 0.5)), ("numeric", "0", "2", ("numeric_drift", 2.0)), ("numeric", "x", "2", ("numeric_drift", 1.0)),
     ("method_name", "BERT", "bert", ("verified", 0.0)), ("symbol", "a", "A", ("symbol_drift", 1.0)), ("other", "a", "a", ("partial", 0.5))],
)
def test_drift(spark, kind, a, b, want):
    s = lambda x: F.struct(F.lit(x).alias("normalized"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("direction"))
    assert tuple(one(spark, facts.drift(F.lit(kind), s(a), s(b)), s="")) == want


def test_anchor_kept(spark):
    kept = lambda kind, surface, target: one(spark, facts.anchor_kept(F.lit(kind), F.col("s"), F.lit(None).cast("string"), F.col("t")), s=surface, t=target)
    assert kept("numeric", "1,234 items", "1234 个")
    assert kept("numeric", "two", "2 个")
    assert not kept("numeric", "two", "zwei")
    assert kept("citation", "X (2017)", "X2017") and not kept("citation", "X (2017)", "X2018")
    assert kept("symbol", "α = 1", "取 α=1") and not kept("comparison", "a", "a") and not kept("method_name", "abc", None)


def test_batches_like_a_fold(spark):
    rng = random.Random(5)
    rows = [(p, i, "x" * rng.choice([0, 5, 80, 400, 1300])) for p in range(3) for i in range(rng.randrange(1, 90))]
    df = spark.createDataFrame(rows, "p int, o int, s string")
    got = {(r.p, r.o): r.batch for r in order.batches(df, ["p"], "o", "s", 10, 1000, 300).collect()}
    for p in range(3):
        items, want, b = [r for r in rows if r[0] == p], {}, -1
        for i in range(0, len(items), 10):
            chars = toks = 0
            b += 1
            for _, o, s in items[i : i + 10]:
                n, t = len(s), max(1, len(s) // 2)
                by_chars, by_toks = chars > 0 and chars + n > 1000, toks > 0 and toks + t > 300
                if by_chars or by_toks:
                    b += 1
                    toks = 0
                    chars = 0 if by_chars else chars
                chars, toks = chars + n, toks + t
                want[o] = b
        assert {o: got[p, o] for _, o, _ in items} == want


def test_greedy_match(spark):
    s = spark.createDataFrame([(1, 1, "numeric", "5", 0), (1, 2, "numeric", "7", 1), (1, 3, "symbol", "a", None), (2, 4, "symbol", "b", None)], "u int, c bigint, kind string, normalized string, precision int")
    t = spark.createDataFrame([(1, 10, "numeric", "9", 1), (1, 11, "numeric", "5", 2)], s.schema)
    got = {r.source_id: r.target_id for r in match.greedy_match(s, t, "u", "c").collect()}
    assert got == {1: 11, 2: 10, 3: None, 4: None}


def test_longest_prefix(spark):
    u = spark.createDataFrame([(1, "/a/b[2]/c"), (1, "/a/x"), (1, "/z"), (1, None)], "p int, x string")
    s = spark.createDataFrame([(1, "/a", 1), (1, "/a/b[2]", 2), (1, "/a/b", 3)], "p int, sx string, i int")
    got = {r.x: r.matched_section for r in match.longest_prefix(u, s, ["p"], "x", "sx", "i").collect()}
    assert got == {"/a/b[2]/c": 2, "/a/x": 1, "/z": None, None: None}


def test_statistics(spark):
    d = spark.createDataFrame([("k", u, float(v)) for u, v in [(1, 1), (1, 2), (2, 5), (2, 5), (3, 9), (3, 7), (4, 4)]], "k string, u int, v double")
    a = statistics.krippendorff(d, ["k"], "u", "v").first()
    assert a.n_values == 6 and 0.9 < a.alpha < 1
    o = spark.createDataFrame([("a", 0, 2), ("a", 1, 1), ("a", 2, 0), ("b", 0, 0)], "k string, x int, y int")
    assert {r.k: r.tau for r in statistics.kendall(o, ["k"], "x", "y").collect()} == {"a": -1.0, "b": 1.0}
    assert statistics.spearman(d.select("k", "v", (-F.col("v")).alias("w")), ["k"], "v", "w").first().spearman == pytest.approx(-1.0)


def test_gate_and_allocation(spark):
    d = spark.createDataFrame([(True, None, None), (False, 0.8, 0.1), (False, None, None), (None, 1.0, 0.3)], "is_fallback boolean, fps_unit double, xcomet_score double")
    got = [(r.reasons, r.flag, round(r.risk, 3)) for r in review.gate(d).collect()]
    assert got == [(["fallback"], True, 1.0), (["fps", "xcomet"], True, 0.6), ([], False, 0.0), ([], False, 0.0)]
    pools = spark.createDataFrame([(1, 7), (2, 2), (3, 1)], "j int, n bigint")
    assert {r.j: r.allocated for r in review.allocation(pools, "j", "n", 5).collect()} == {1: 4, 2: 1, 3: 0}
    assert sum(r.allocated for r in review.allocation(pools, "j", "n", 5).collect()) == 5
    assert {r.j: r.allocated for r in review.allocation(pools, "j", "n", 50).collect()} == {1: 7, 2: 2, 3: 1}


def test_quality(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "b"), (None, "b")], "k int, v string")
    assert {(r.k, r.rows) for r in quality.repeated_keys(d, ["k"]).collect()} == {(1, 2), (None, 2)}
    p = spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in quality.orphans(d, p, "k", "k").collect()] == [2]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k int, o int, s string")
    assert order.batches(e, ["k"], "o", "s").count() == 0
    assert order.latest(e, ["k"], [F.desc("o")]).count() == 0
    assert contract.units(e, "k", "s", "html").count() == 0
    assert statistics.krippendorff(e, ["k"], "o", "o").count() == 0
