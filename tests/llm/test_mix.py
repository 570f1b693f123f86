"""Budgets on trees, and the uses of documents."""

import random

import pytest

from scriptorium.llm import mix


def test_hand_down_keeps_the_total():
    leaves = [("a", "en", 100.0, 0.5, 2.0), ("b", "en", 1000.0, 0.3, 1.0), ("c", "fr", 10.0, 0.2, 3.0)]
    got = mix.budgets(leaves, 400.0)
    assert sum(got.values()) == pytest.approx(400)
    assert got["c", "fr"] == pytest.approx(30) and got["a", "en"] <= 200 and got["b", "en"] <= 1000
    assert sum(mix.budgets(leaves, 1e9).values()) == pytest.approx(100 * 2 + 1000 + 30)


def test_siblings_before_others():
    leaves = [("abstracts", "en", 10.0, 0.4, 1.0), ("theses", "en", 1000.0, 0.3, 1.0), ("captions", "en", 1000.0, 0.3, 1.0)]
    got = mix.budgets(leaves, 100.0, {"abstracts": "papers", "theses": "papers"})
    # what the abstracts lack goes to the theses of the same domain and language
    assert got == pytest.approx({("abstracts", "en"): 10.0, ("theses", "en"): 60.0, ("captions", "en"): 30.0})


def test_domains_as_a_table(spark):
    """The shortage of one source goes to the source of its domain."""
    rows = [(1, "a", "en", 10)] + [(i, s, "en", 100) for s in "bc" for i in range(2, 60)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 1), ("c", 0.3, 1)], "source string, target_share double, max_repeats int")
    domains = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "y"), ("c", None)], "source string, domain string")
    used = {r.source: r.used_tokens for r in mix.report(sizes, targets, total=1000.0, domains=domains).collect()}
    assert used["a"] == 10 and used["b"] == pytest.approx(690, abs=60) and used["c"] == pytest.approx(300, abs=60)


def frames(spark, rows):
    sizes = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long").repartition(5)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 1), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    return sizes, targets


def test_uses(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "b", "b", None, "other"]), rng.choice(["en", "fr", None]), rng.choice([0, 5, 50, 300])) for i in range(3000)]
    sizes, targets = frames(spark, rows)
    used = mix.uses(sizes, targets).collect()
    assert all(1 <= u.uses <= {"a": 2, "b": 1}[u.source] for u in used) and len({u.doc_id for u in used}) == len(used)
    again = mix.uses(sizes.repartition(2), targets).collect()
    assert {(u.doc_id, u.uses) for u in used} == {(u.doc_id, u.uses) for u in again}
    r = {x.source: x for x in mix.report(sizes, targets).collect()}
    # the source without documents can't be met; as the first is used up at its target, the second takes that part
    assert not r["none"].met and r["none"].used_tokens == 0 and r["a"].share == pytest.approx(0.5, abs=0.02)
    assert sum(x.share for x in r.values()) == pytest.approx(1.0)


def test_short_source(spark):
    rows = [(1, "a", "en", 10)] + [(i, "b", "en", 100) for i in range(2, 200)]
    r = {x.source: x for x in mix.report(*frames(spark, rows)).collect()}
    assert r["a"].most_uses == 2 and not r["a"].met and r["b"].most_uses == 1


def test_empty(spark):
    sizes, targets = frames(spark, [(1, "a", "en", 3)])
    r = mix.report(sizes.limit(0), targets).collect()
    assert len(r) == 3 and all(x.used_tokens == 0 and x.share == 0 and not x.met for x in r)
