"""Sinks: text, CSV, JSON, XML and HTML, resumable and atomic ones, updates in place, and a ledger of stages.

All write through Spark's commit protocol, so a failed job leaves nothing half written; what is said to be one file is a
report small enough for one task.
"""

from __future__ import annotations

import html
import os
import re
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.order import latest


def there(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at `path`; None if there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def update(changes: DataFrame, path: str, keys: list[str], by: list[str]) -> None:
    """Sets columns of rows already in a partitioned table: only partitions with changed rows are written anew.

    `changes` has the keys, the partition columns `by` and some of the table's columns; null leaves a value as it is.
    """
    spark = changes.sparkSession
    old = spark.read.parquet(path)
    touched = old.join(changes.select(*by).distinct(), by, "left_semi")
    new = [c for c in changes.columns if c not in keys and c not in by]
    c = changes.select(*keys, *by, *[F.col(x).alias(f"_new_{x}") for x in new])
    out = touched.join(c, [*keys, *by], "left").select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in new else F.col(x) for x in old.columns])
    # the table can't be read while it is written
    aside = f"{path.rstrip('/')}.update"
    out.write.mode("overwrite").parquet(aside)
    spark.read.schema(out.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    _hadoop_delete(spark, aside)


def _hadoop_delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def csv_report(df: DataFrame, path: str, parts: int = 1) -> None:
    """A CSV with a header, nulls as empty fields; one file unless more are asked for."""
    df.coalesce(parts).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def csv_file(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One CSV file for a spreadsheet, with a byte order mark, replaced at once; what was there first is kept as .bak.

    For reports of `most` rows at most: a larger frame is refused.
    """
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use csv_report")
    if os.path.exists(path) and not os.path.exists(f"{path}.bak"):
        shutil.copy(path, f"{path}.bak")
    rows.to_csv(f"{path}.tmp", index=False, encoding="utf-8-sig")
    os.replace(f"{path}.tmp", path)


def append_groups(df: DataFrame, path: str, group: list[str]) -> int:
    """Appends the groups that the table at `path` lacks, whole; gives how many were new. Calling it again adds nothing."""
    old = there(df.sparkSession, path)
    new = df if old is None else df.join(old.select(*group).distinct(), group, "left_anti")
    n = new.select(*group).distinct().count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def each_batch(path: str, group: list[str]) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: appends each batch's new groups, so a batch that comes again changes nothing."""
    return lambda batch, _: append_groups(batch, path, group) and None


def json_lines(df: DataFrame, path: str) -> None:
    """A JSON object a row; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def id_list(df: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column in order, one a line."""
    df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def xml_files(docs: DataFrame, name: str, xml: str, folder: str) -> DataFrame:
    """Writes each document as <name>.xml with a declaration into a folder all executors see; gives (name, size). Written aside first, then renamed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for f in frames:
            out = []
            for k, x in zip(f[name], f[xml], strict=True):
                if x is None:
                    continue
                body = ('<?xml version="1.0" encoding="UTF-8"?>\n' + x).encode()
                at = os.path.join(folder, re.sub(r"[^\w.-]", "_", str(k)) + ".xml")
                with open(f"{at}.{os.getpid()}", "wb") as w:
                    w.write(body)
                os.replace(f"{at}.{os.getpid()}", at)
                out.append((str(k), len(body)))
            yield pd.DataFrame(out, columns=["name", "size"])

    return docs.select(name, xml).mapInPandas(run, "name string, size long")


def with_unit_ids(markup: str, ids: list[int], tags: tuple[str, ...] = ("p", "h1", "h2", "h3", "figcaption")) -> str:
    """HTML whose text elements carry data-unit attributes, in the order in which they stand; what is left over gets none."""
    left = iter(ids)

    def mark(m: re.Match) -> str:
        n = next(left, None)
        return m[0] if n is None else f'{m[1]} data-unit="{n}"{m[2]}'

    return re.sub(rf"(<(?:{'|'.join(tags)})\b)((?:\s[^>]*)?>)", mark, markup)


def with_images(markup: str, links: dict[str, str]) -> str:
    """HTML whose images point where `links` says, by the last part of their address; others stay."""
    return re.sub(r"""(<img[^>]*?\ssrc=)(["'])([^"']+)\2""", lambda m: f"{m[1]}{m[2]}{html.escape(links.get(m[3].rpartition('/')[2], m[3]))}{m[2]}", markup)


def bilingual_page(title: str, pairs: list[tuple[int, str | None, str | None, float | None]]) -> str:
    """An HTML page of (unit, source, target, score), with the scores as data beside it."""
    show = lambda x: html.escape(x or "")
    rows = "\n".join(f'<tr data-unit="{n}"><td>{show(s)}</td><td>{show(t)}</td></tr>' for n, s, t, _ in pairs)
    scores = ",".join(f'"{n}":{"null" if q is None else round(q, 4)}' for n, _, _, q in pairs)
    return f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{show(title)}</title></head><body><table>\n{rows}\n</table><script type="application/json" id="quality">{{{scores}}}</script></body></html>'


def pages(units: DataFrame, doc: str, title: str) -> DataFrame:
    """(doc, page) of `units` (doc, title, unit_id, ord, src_plain, tgt_plain, score): a page for each document, its units in order."""
    rows = units.groupBy(doc).agg(F.first(title).alias("_title"), F.array_sort(F.collect_list(F.struct("ord", "unit_id", "src_plain", "tgt_plain", F.col("score").cast("double").alias("score")))).alias("_u"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [bilingual_page(t or "", [(u["unit_id"], u["src_plain"], u["tgt_plain"], u["score"]) for u in us]) for t, us in zip(f["_title"], f["_u"], strict=True)]
            yield pd.DataFrame({doc: f[doc], "page": out})

    return rows.mapInPandas(run, f"{doc} {dict(units.dtypes)[doc]}, page string")


def state_of(events: DataFrame, order: Column) -> DataFrame:
    """The state of each job from a ledger of (job_id, stage, outcome, at): its last event."""
    return latest(events, ["job_id"], [order])


def resumed(jobs: DataFrame, events: DataFrame, stages: list[str]) -> DataFrame:
    """(job_id, next_stage) of `jobs` (job_id): the first stage of `stages` not done yet; null if all are done.

    A stage counts as done if any of its events says so; stages after one that isn't done run again.
    """
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    done = events.where("outcome = 'done'").select("job_id", place.alias("n")).where("n > 0").groupBy("job_id").agg(F.array_sort(F.collect_set("n")).alias("done"))
    wanted = F.sequence(F.lit(1), F.lit(len(stages))).cast("array<bigint>")
    missing = F.array_min(F.array_except(wanted, F.coalesce("done", F.array().cast("array<bigint>"))))
    return jobs.select("job_id").join(done, "job_id", "left").select("job_id", F.get(F.array(*map(F.lit, stages)), (missing - 1).cast("int")).alias("next_stage"))


def finished(groups: DataFrame, parts: list[str], key: str, part: str) -> DataFrame:
    """(key, complete): whether a key has every part of a list."""
    have = groups.groupBy(key).agg(F.collect_set(part).alias("_have"))
    return have.select(key, (F.size(F.array_except(F.array(*map(F.lit, parts)), "_have")) == 0).alias("complete"))

