"""Sources on small files, and streams against the same operators on tables."""

from pyspark.sql import functions as F

from scriptorium.sources import formats
from scriptorium.streaming import events as stream


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,score,ok\n1,2.5,True\n2,x,\n", encoding="utf-8")
    rows = formats.csv(spark, str(tmp_path / "a.csv"), ("score",), ("ok",)).collect()
    assert [(r.id, r.score, r.ok) for r in rows] == [("1", 2.5, True), ("2", None, None)]
    (tmp_path / "ids.txt").write_text("# all\n\n a \nb\n")
    assert [r.value for r in formats.lines(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    (tmp_path / "t.md").write_text("| en | zh |\n|---|---|\n| Model | 模型/样式 |\n| model | 另一个 |\n")
    assert [tuple(r) for r in formats.pipe_table(spark, str(tmp_path / "t.md")).collect()] == [("model", "模型")]
    (tmp_path / "b.tbx").write_text('<termEntry><langSet xml:lang="en-US"><term>File</term></langSet><langSet xml:lang="fr-FR"><term>Fichier</term></langSet></termEntry>')
    assert [tuple(r) for r in formats.term_base(spark, str(tmp_path / "b.tbx"), "fr").collect()] == [("file", "Fichier")]
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert formats.json_array(spark, str(tmp_path / "x.json")).count() == 2


def test_paged_harvest(spark, tmp_path):
    (tmp_path / "h.xml").write_text("".join(f"<record><identifier>{i}</identifier><datestamp>d</datestamp><title>T &amp; {i}</title></record>" for i in range(25)))
    spark.dataSource.register(formats.PagedHarvest)
    df = spark.read.format("paged_harvest").option("path", str(tmp_path / "h.xml")).option("pagesize", "10").load()
    assert df.count() == 25 and df.where("identifier = '7'").first().title == "T & 7"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    formats.append_absent(d, str(tmp_path / "t"), ["k"])
    formats.append_absent(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), str(tmp_path / "t"), ["k"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    for _ in range(2):
        formats.replace_partitions(d, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert "N/A" in formats.latex_table([("a_b", None)], ["x", "y"])


def _stream(spark, smallest, tmp_path):
    events = spark.read.parquet(f"{smallest}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # a file for each stretch of time, so that no row is late
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 250).parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_windows_on_a_stream(spark, smallest, tmp_path):
    events, s = _stream(spark, smallest, tmp_path)
    _run(stream.windowed(s, "1 hour"), tmp_path, "windows")
    got = {(r.start, r.event_type): r.events for r in spark.table("windows").collect()}
    want = {(r.start, r.event_type): r.events for r in stream.windowed(events, "1 hour").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_sessions_agree(spark, smallest):
    events = spark.read.parquet(f"{smallest}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    a = sorted((r.user_id, str(r.start), r.events) for r in stream.sessions(events, "30 minutes").collect())
    b = sorted((r.user_id, str(r.start), r.events) for r in stream.batch_sessions(events, 1799).collect())
    assert a == b


def test_bucket_on_a_stream(spark, smallest, tmp_path):
    events, s = _stream(spark, smallest, tmp_path)
    _run(stream.token_bucket(s, "event_type", "value", 0.05, 500.0), tmp_path, "bucket")
    assert spark.table("bucket").count() == events.count()
    table = stream.token_bucket(events, "event_type", "value", 0.05, 500.0)
    assert table.where("wait_s < 0 or level < -1e-6 or level > 500").count() == 0
