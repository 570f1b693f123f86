"""Readers of the text formats of the corpus tools, and their writers."""

from __future__ import annotations

import html
import os
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptorium.functions.text import strip


def coerced(df: DataFrame) -> DataFrame:
    """A frame of strings with empty ones made null."""
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def csv(spark: SparkSession, path: str, numbers: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, read as strings; `numbers` become doubles (null if they aren't), `flags` booleans.

    A byte order mark before the first name is dropped.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = coerced(df.toDF(*[c.lstrip("﻿") for c in df.columns]))
    return df.withColumns({c: F.col(c).try_cast("double") for c in numbers} | {c: F.col(c) == "True" for c in flags})


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the trimmed lines of a file without blank ones and comments."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> '' and not startswith(value, '#')")


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON file that holds one array."""
    return spark.read.json(path, multiLine=True)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a small file: the line numbers tell which of two entries came first."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def pipe_table(spark: SparkSession, path: str) -> DataFrame:
    """(term, rendering) of a table drawn with pipes: lower case term, first of alternatives, first entry of a term."""
    cells = F.split("line", r"\|")
    rows = _numbered(spark, path).where(F.size(cells) >= 4).select("n", F.lower(strip(cells[1])).alias("term"), strip(F.split(strip(cells[2]), "/")[0]).alias("rendering"))
    rows = rows.where("term <> '' and rendering <> '' and not term rlike '^[-: ]+$'")
    w = Window.partitionBy("term").orderBy("n")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1 and n > 0").select("term", "rendering")


def term_base(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(term, rendering) of a TBX file: the English term of an entry and that of `lang`, first entry of a term."""
    entry = F.regexp_extract_all("value", F.lit(r"(?s)<termEntry.*?</termEntry>"), F.lit(0))
    e = spark.read.text(path, wholetext=True).select(F.posexplode(entry).alias("n", "entry"))

    def term(code: str):
        pattern = rf'(?s)<langSet[^>]*xml:lang="{code}[^"]*".*?<term[^>]*>(.*?)</term>'
        return strip(F.regexp_extract("entry", pattern, 1))

    rows = e.select("n", F.lower(term("en")).alias("term"), term(lang).alias("rendering")).where("term <> '' and rendering <> ''")
    w = Window.partitionBy("term").orderBy("n")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("term", "rendering")


def documents(spark: SparkSession, folder: str, glob: str = "*.xml") -> DataFrame:
    """(path, text) of the files of a folder; which ones, a glob says."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.decode("content", "UTF-8").alias("text"))


def scored_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(src, mt, human_score) of a CSV of judged translations; rows without a score that is a number, or without text, are left out."""
    return csv(spark, path, ("human_score",)).select("src", "mt", "human_score").where("src is not null and mt is not null and human_score is not null")


def folder(spark: SparkSession, path: str, glob: str = "*.xml", limit: int | None = None) -> DataFrame:
    """(path, text) of a folder's files in order of path, the first `limit` if one is given."""
    found = documents(spark, path, glob)
    return found if limit is None else found.orderBy("path").limit(limit)


def for_language(paths: list[str], words: tuple[str, ...]) -> str | None:
    """The first path whose file name holds one of a language's words, whatever its case; else the first of all; None of none."""
    return next((p for p in sorted(paths) if any(w.lower() in p.rpartition("/")[2].lower() for w in words)), min(paths, default=None))


def archives(spark: SparkSession, path: str, glob: str = "*.tar*") -> DataFrame:
    """(path, member, content) of the files in tar archives; members that lead out of the archive, links and folders are left out, and so are broken archives."""

    def run(frames: Iterator) -> Iterator:
        import io
        import tarfile

        import pandas as pd

        for f in frames:
            rows = []
            for at, content in zip(f["path"], f["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for m in tar:
                            if m.isfile() and not m.name.startswith("/") and ".." not in m.name.split("/"):
                                rows.append((at, m.name, tar.extractfile(m).read()))
                except tarfile.TarError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "content"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return raw.mapInPandas(run, "path string, member string, content binary")


def figure_links(pages: DataFrame, page_id: str, markup: str) -> DataFrame:
    """(page_id, name, url): the last part of each image's address on an HTML page, and the address; the first of a name counts."""
    src = F.regexp_extract_all(markup, F.lit(r"""<img[^>]*?\ssrc=["']([^"']+)["']"""), F.lit(1))
    rows = pages.select(page_id, F.posexplode(src).alias("n", "url")).withColumn("name", F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1))
    w = Window.partitionBy(page_id, "name").orderBy("n")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1 and name <> ''").select(page_id, "name", "url")


def looked_up(df: DataFrame, key: str, found: DataFrame, found_key: str, columns: list[str]) -> DataFrame:
    """`df` with columns of a fetched table by key, null where nothing was fetched; of several rows of a key the one with the greatest values counts.

    Stands for lookups of licences, citations and labels: what a service answered is kept as a table and joined.
    """
    one = found.where(F.col(found_key).isNotNull()).groupBy(F.col(found_key).alias("_k")).agg(F.max(F.struct(*columns)).alias("_v"))
    return df.join(one, F.lower(F.col(key)) == F.lower("_k"), "left").select(df["*"], *[F.col(f"_v.{c}").alias(c) for c in columns])


def main_tex(files: DataFrame) -> DataFrame:
    """Of (path, text) of LaTeX files, the first in order of path that holds a document class."""
    return files.where(F.contains("text", F.lit("\\documentclass"))).orderBy("path").limit(1)


class _Page(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


def _records(page: str) -> Iterator[tuple]:
    """(identifier, datestamp, title) of each record of a page."""
    for m in re.finditer(r"(?s)<record>(.*?)</record>", page):
        field = lambda tag, body=m[1]: (x := re.search(rf"(?s)<{tag}>(.*?)</{tag}>", body)) and html.unescape(x[1].strip())
        yield field("identifier"), field("datestamp"), field("title")


def resumption_token(page: str) -> str | None:
    """What a page of a harvest says to ask for next; None on the last one."""
    m = re.search(r"(?s)<resumptionToken[^>]*>(.*?)</resumptionToken>", page)
    return (html.unescape(m[1].strip()) or None) if m else None


def fetched(get: Callable[[], str], tries: int = 5, wait: Callable[[float], None] = time.sleep, first: float = 1.0) -> str:
    """What `get` gives; on OSError it is asked again, after what the error's retry_after says or twice as long each time."""
    for n in range(tries):
        try:
            return get()
        except OSError as e:
            if n == tries - 1:
                raise
            wait(getattr(e, "retry_after", None) or first * 2**n)
    raise ValueError("tries must be 1 or more")


class PagedReader(DataSourceReader):
    """Reads a harvest page by page: pages are files of a folder all executors see, or one file that holds all records.

    The chain of resumption tokens is followed once, on the driver, which keeps only names of pages; each page is a
    partition, so pages are read side by side and again if lost.
    """

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def _get(self, name: str) -> str:
        with open(f"{self.path}/{name}" if name else self.path, encoding="utf-8") as f:
            return f.read()

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.path):
            return [_Page("")]
        out, name, met = [], "first.xml", set()
        while name and name not in met:
            met.add(name)
            out.append(_Page(name))
            token = resumption_token(fetched(lambda name=name: self._get(name)))
            name = f"{token}.xml" if token else None
        return out

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from _records(fetched(lambda: self._get(partition.name)))


class PagedHarvest(DataSource):
    """A metadata harvest as a source: spark.dataSource.register(PagedHarvest), format "paged_harvest"."""

    @classmethod
    def name(cls) -> str:
        return "paged_harvest"

    def schema(self) -> str:
        return "identifier string, datestamp string, title string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def append_absent(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table at `path` lacks; a table that isn't there yet is made."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(*keys).distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    (df if there is None else df.join(there, keys, "left_anti")).write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes `df` in place of the partitions it has rows of, so that writing it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def latex_table(rows: list[tuple], header: list[str]) -> str:
    """A small collected table as LaTeX; nulls are shown as N/A, underscores are escaped."""
    show = lambda v: "N/A" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = [" & ".join(map(show, r)) + r" \\" for r in [tuple(header), *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(header)}}}", *body, r"\end{tabular}"])
