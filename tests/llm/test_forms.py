"""Consistent forms and pairs that agree only in them."""

import itertools
import random

from pyspark.sql import functions as F

from scriptorium.llm.forms import alike, form, forms


def test_form():
    assert form("ﬁｘ　Ａ") == "fix A"
    assert form("été") == "été" and form("a​b­c﻿") == "abc" and form("a b c") == "a b c"
    assert form("Каr") == "Kar" and form("ΑΒο") == "ABo"
    assert form("10³") == "10³" and form("Straße") == "Straße" and form("Straße", True) == "strasse"
    assert form("a\n b") == "a\n b" and form("naïve") != form("naive") and form(None) is None and form("") == ""


def test_composed_and_decomposed_agree():
    import unicodedata

    for text in ("ёлка", "ό", "їжа", "ѐ", "Ё é ﬁ", "ἀ", "ΐ", "Å", "が", "각"):
        forms_of = {form(unicodedata.normalize(k, text)) for k in ("NFC", "NFD")}
        assert len(forms_of) == 1, text
        assert len({form(unicodedata.normalize(k, text), True, True) for k in ("NFC", "NFD", "NFKC", "NFKD")}) == 1, text
    assert form("ё") == form("ë") and form("ё") != form("e")


def test_full_compatibility():
    assert [form(x, True, True) for x in ("①", "㎏", "Ⅳ", "℃", "10³", "ẞ", "ﬀ")] == ["1", "kg", "iv", "°c", "103", "ss", "ff"]
    assert form("①") == "①" and form("İ", True) == form("i̇", True)


def test_pairs_like_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        t = rng.choice(["Related Work", "C'est été", "x y", " "])
        t = "".join(rng.choice([c, c, c, c + "​", c.replace(" ", " ")]) for c in t)
        rows.append((rng.choice(["src", "tgt"]), i, t))
    rows += [("src", 500, None), ("src", 501, ""), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "side string, row_id int, text string").withColumn("key", F.lit("clash"))
    got = [tuple(r) for r in alike(df, F.col("side"), F.col("row_id"), F.col("text"), rows_a_salt=3).collect()]
    want = set()
    for (s, i, t), (u, j, v) in itertools.product(rows, rows):
        if s == u and i < j and t != v and t and v and form(t).strip() and form(t) == form(v):
            want.add((s, i, j))
    assert len(got) == len(set(got)) and set(got) == want


def test_edges(spark):
    df = spark.createDataFrame([(1, "A" * 200_000), (2, None)], "id int, t string")
    assert [len(r.form) if r.form else r.form for r in forms(df, ["id"], "t").orderBy("id").collect()] == [200_000, None]
    assert forms(df.limit(0), ["id"], "t").count() == 0
    e = spark.createDataFrame([], "s string, i int, t string")
    assert alike(e, F.col("s"), F.col("i"), F.col("t")).count() == 0
