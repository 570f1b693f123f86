"""Sinks, ledgers, lookups, producers and stages on small frames."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import producers, review, select
from scriptorium.operators.fold import chunked, folded
from scriptorium.sources import formats, sinks


def test_update_touches_only_its_partitions(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([(1, 10, None, "a"), (2, 10, 0.5, "b"), (3, 20, None, "c")], "id int, job int, score double, v string").write.partitionBy("job").parquet(at)
    before = {f for f in (tmp_path / "t" / "job=20").iterdir()}
    sinks.update(spark.createDataFrame([(1, 10, 0.9), (9, 10, 1.0)], "id int, job int, score double"), at, ["id"], ["job"])
    got = {(r.id, r.job, r.score, r.v) for r in spark.read.parquet(at).collect()}
    assert got == {(1, 10, 0.9, "a"), (2, 10, 0.5, "b"), (3, 20, None, "c")}
    assert before == {f for f in (tmp_path / "t" / "job=20").iterdir()} and not (tmp_path / "t.update").exists()


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([(1, None, 'x "y"'), (2, "b", None)], "k int, v string, w string")
    sinks.csv_report(d.orderBy("k"), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.splitlines() == ["k,v,w", '1,,"x ""y"""', "2,b,"]
    for k in (1, 2):
        sinks.csv_file(d.where(F.col("k") == k), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf") and "b" in (tmp_path / "r.csv").read_text() and "x" in (tmp_path / "r.csv.bak").read_text()
    with pytest.raises(ValueError):
        sinks.csv_file(d, str(tmp_path / "r.csv"), most=1)
    sinks.json_lines(d, str(tmp_path / "j"))
    rows = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(r["k"] for r in rows) == [1, 2] and all("v" in r for r in rows)
    sinks.id_list(d.union(d), "k", str(tmp_path / "i"))
    assert next((tmp_path / "i").glob("*.txt")).read_text() == "1\n2\n"


def test_groups_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "g int, v string")
    assert [sinks.append_groups(d, str(tmp_path / "g"), ["g"]) for _ in range(2)] == [2, 0]
    sinks.each_batch(str(tmp_path / "g"), ["g"])(d.union(spark.createDataFrame([(3, "z")], d.schema)), 0)
    assert spark.read.parquet(str(tmp_path / "g")).count() == 4
    assert {r.k: r.complete for r in sinks.finished(d.toDF("k", "p"), ["a", "b"], "k", "p").collect()} == {1: True, 2: False}


def test_documents_and_pages(spark, tmp_path):
    d = spark.createDataFrame([("a/1", "<d>é</d>"), ("b", None)], "name string, xml string")
    assert [(r.name, r.size) for r in sinks.xml_files(d, "name", "xml", str(tmp_path / "x")).collect()] == [("a/1", 48)]
    assert (tmp_path / "x" / "a_1.xml").read_text().endswith("<d>é</d>")
    assert sinks.with_unit_ids('<p class="x">a</p><pre>b</pre><p>c</p><p>d</p>', [7, 8]) == '<p class="x" data-unit="7">a</p><pre>b</pre><p data-unit="8">c</p><p>d</p>'.replace('<p class="x" data-unit="7">', '<p data-unit="7" class="x">')
    assert sinks.with_images("<img alt='' src='f/a.png'><img src=\"b.png\">", {"a.png": "http://x/a"}) == "<img alt='' src='http://x/a'><img src=\"b.png\">"
    u = spark.createDataFrame([(1, "T & t", 5, 2, "s<2>", None, None), (1, "T & t", 4, 1, "s1", "t1", 0.5)], "doc int, title string, unit_id int, ord int, src_plain string, tgt_plain string, score double")
    page = sinks.pages(u, "doc", "title").first().page
    assert page.index("s1") < page.index("s&lt;2&gt;") and '{"4":0.5,"5":null}' in page and "T &amp; t" in page


def test_ledger(spark):
    e = spark.createDataFrame([(1, "a", "done", 1), (1, "b", "failed", 2), (2, "a", "done", 1), (2, "b", "done", 2), (2, "c", "done", 3)], "job_id int, stage string, outcome string, at int")
    assert {r.job_id: (r.stage, r.outcome) for r in sinks.state_of(e, F.desc("at")).collect()} == {1: ("b", "failed"), 2: ("c", "done")}
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id int")
    assert {r.job_id: r.next_stage for r in sinks.resumed(jobs, e, ["a", "b", "c"]).collect()} == {1: "b", 2: None, 3: "a"}


def test_more_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text("src,mt,human_score\na,b,0.5\nc,d,bad\n,e,1\n")
    assert [tuple(r) for r in formats.scored_pairs(spark, str(tmp_path / "w.csv")).collect()] == [("a", "b", 0.5)]
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.xml").write_text(f"<{n}/>")
    assert [r.text for r in formats.folder(spark, str(tmp_path), limit=2).collect()] == ["<a/>", "<b/>"]
    assert formats.for_language(["x/French.tbx", "x/de.tbx"], ("fr", "french")) == "x/French.tbx" and formats.for_language(["x/b", "x/a"], ("zz",)) == "x/a" and formats.for_language([], ("a",)) is None
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name in ("main.tex", "../evil", "/abs", "d/x.tex"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"ab"))
    (tmp_path / "p.tar.gz").write_bytes(buffer.getvalue())
    (tmp_path / "bad.tar").write_bytes(b"no archive")
    assert sorted(r.member for r in formats.archives(spark, str(tmp_path)).collect()) == ["d/x.tex", "main.tex"]
    page = spark.createDataFrame([(1, "<img class='a' src='u/f1.jpg?x=1'><img src=\"v/f1.jpg\"><img src='w/f2.png'>")], "id int, page string")
    assert {(r.name, r.url) for r in formats.figure_links(page, "id", "page").collect()} == {("f1.jpg", "u/f1.jpg?x=1"), ("f2.png", "w/f2.png")}
    d = spark.createDataFrame([("A",), ("b",), (None,)], "k string")
    f = spark.createDataFrame([("a", 1), ("a", 3), (None, 9)], "id string, n int")
    assert {(r.k, r.n) for r in formats.looked_up(d, "k", f, "id", ["n"]).collect()} == {("A", 3), ("b", None), (None, None)}


def test_harvest_follows_tokens(spark, tmp_path):
    record = lambda i: f"<record><identifier>{i}</identifier><datestamp>d</datestamp><title>T{i}</title></record>"
    (tmp_path / "first.xml").write_text(record(1) + record(2) + "<resumptionToken>two</resumptionToken>")
    (tmp_path / "two.xml").write_text(record(3) + "<resumptionToken/>")
    (tmp_path / "other.xml").write_text(record(9))
    spark.dataSource.register(formats.PagedHarvest)
    df = spark.read.format("paged_harvest").option("path", str(tmp_path)).load()
    assert sorted(r.identifier for r in df.collect()) == ["1", "2", "3"]
    waits, answers = [], [OSError("busy"), OSError("busy"), "text"]
    answers[1].retry_after = 7

    def get():
        x = answers.pop(0)
        if isinstance(x, OSError):
            raise x
        return x

    assert formats.fetched(get, wait=waits.append) == "text" and waits == [1.0, 7]
    with pytest.raises(OSError):
        formats.fetched(lambda: (_ for _ in ()).throw(OSError()), tries=2, wait=waits.append)


def test_producers(spark):
    d = spark.createDataFrame([(1, "a {{PT_M_1}} 12"), (2, None)], "id int, p string")
    said = {n: [r.answer.text for r in producers.produced(d, "p", p).orderBy("id").collect()] for n, p in producers.REGISTRY.items()}
    assert said == {"identity": ["a {{PT_M_1}} 12", None], "token-dropper": ["a  12", None], "figure-shifter": ["a {{PT_M_2}} 12", None], "silent": [None, None]}
    broken = producers.Producer("broken", lambda: lambda x: 1 // 0)
    assert producers.produced(d, "p", broken).orderBy("id").first().answer.error.startswith("ZeroDivisionError")
    assert producers.registry(spark).count() == 4
    s = producers.scored(d.withColumn("q", F.lit("b" * 8)), "p", "q", producers.length_ratio).orderBy("id").collect()
    assert s[0].score == pytest.approx(8 / 15) and s[1].score is None
    runs = spark.createDataFrame([(1, 2.0, ["b"]), (1, 4.0, ["a", "b"]), (1, 3.0, None)], "u int, s double, e array<string>")
    assert tuple(producers.judged(runs, ["u"], ["s"], "e").first()) == (1, 3, 3.0, ["a", "b"])


def test_stages(spark):
    store, frames = {}, {"a": spark.range(3)}
    ok = producers.Stage("one", ("a",), ("b",), lambda a: {"b": a.where("id > 0")})
    bad = producers.Stage("two", ("b",), ("c",), lambda b: 1 / 0)
    save = lambda k, x: store.setdefault(k, x)
    out, log = producers.run_stages(frames, [ok, bad], save, store.get)
    assert out["b"].count() == 2 and log == [("one", "done"), ("two", "failed")]
    assert producers.run_stages(frames, [ok], save, store.get)[1] == [("one", "skipped")]
    with pytest.raises(ZeroDivisionError):
        producers.run_stages(out, [producers.Stage("two", ("b",), ("c",), lambda b: 1 / 0, recoverable=False)], save, store.get)


def test_folds(spark):
    rows = [(k, i, (i * 7) % 11) for k in ("a", "b", None) for i in range(40)]
    d = spark.createDataFrame(rows, "k string, i int, n int")
    got = {(r.k, r.i): r.s for r in folded(d, ["k"], [F.asc("i")], ["n"], "s bigint", lambda: 0, lambda s, n: (s + n, (s + n,))).collect()}
    assert all(got[k, i] == sum(n for a, b, n in rows if a == k and b <= i) for k, i, _ in rows)
    sizes = [5, 5, 5, 20, 1, 9, 1]
    c = chunked(spark.createDataFrame(list(enumerate(sizes)), "i int, n int").withColumn("k", F.lit(1)), ["k"], [F.asc("i")], "n", 10)
    assert [r.chunk for r in c.orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 4]
    assert chunked(c.drop("chunk").limit(0), ["k"], [F.asc("i")], "n", 10).count() == 0


def test_selection_like_a_greedy_reader(spark):
    import random

    rng = random.Random(2)
    rows = [(g, f"{g}{i}", rng.choice("xyz"), rng.random() < 0.3, rng.randrange(9)) for g in "AB" for i in range(30)]
    d = spark.createDataFrame(rows, "g string, item string, kind string, wanted boolean, c int")
    got = {r.item for r in select.capped(d, "g", "kind", "wanted", [F.desc("c"), F.asc("item")], 5, 2, 3).collect()}
    want = set()
    for g in "AB":
        mine, kinds, taken = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4], r[1])), {}, []
        for limit, pool in ((3, [r for r in mine if r[3]]), (5, mine)):
            for r in pool:
                if r not in taken and len(taken) < limit and kinds.get(r[2], 0) < 2:
                    taken.append(r)
                    kinds[r[2]] = kinds.get(r[2], 0) + 1
        want |= {r[1] for r in taken}
    assert got == want
    x = spark.createDataFrame([("p", "b", 1), ("p", "a", 5), ("q", "b", 9), ("r", "z", 1)], "item string, g string, c int")
    assert {tuple(r) for r in select.cross_listed(x, "item", "g", ["a", "b"], [F.desc("c")], 1).collect()} == {("a", "p"), ("b", "q")}


def test_refining_and_edits(spark):
    d = spark.createDataFrame([(1, 1, 1, 0.2), (1, 2, 1, 0.95), (1, 3, 2, 0.7)], "job_id int, unit_id int, pass_no int, s double")
    got = {(r.unit_id, r.pass_no): (round(r.s, 2), r.is_fallback) for r in review.refined(d, "s", 0.9, 2, lambda f: f.withColumn("s", F.col("s") + 0.25)).collect()}
    assert got == {(1, 1): (0.2, False), (1, 2): (0.45, False), (1, 3): (0.7, True), (2, 1): (0.95, False), (3, 2): (0.7, False), (3, 3): (0.95, False)}
    e = spark.createDataFrame([(1, 1, "t"), (9, 9, "no")], "job_id int, unit_id int, t string")
    assert [(r.unit_id, r.pass_no, r.status) for r in review.edited(e, d).collect()] == [(1, 2, "refined")]
