"""Producers: what a model or a service outside would say, as columns.

A producer turns one prompt into one answer. `produced` applies it to a column in Arrow batches, several at a time, and
gives the answer with what it cost. The offline ones are deterministic, so that all that comes after them can be tested.
A model is made once for each worker, on first use.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "text string, prompt_tokens int, completion_tokens int, elapsed_ms int, model string, error string"


@dataclass(frozen=True)
class Producer:
    """`make` gives the function from prompt to answer; it is called once in each worker."""

    name: str
    make: Callable[[], Callable[[str], str | None]]
    at_once: int = 4
    per_minute: int = 60
    tokens_per_minute: int = 100_000


def estimate(text: str | None) -> int:
    """A rough number of tokens: half the letters, one at least."""
    return max(1, len(text or "") // 2)


def _dropped() -> Callable[[str], str]:
    return lambda x: re.sub(r"\{\{PT_[A-Za-z]+_\d+\}\}", "", x, count=1)


def _shifted() -> Callable[[str], str]:
    return lambda x: re.sub(r"\d+", lambda m: str(int(m[0]) + 1), x, count=1)


IDENTITY = Producer("identity", lambda: lambda x: x)
TOKEN_DROPPER = Producer("token-dropper", _dropped)
FIGURE_SHIFTER = Producer("figure-shifter", _shifted)
SILENT = Producer("silent", lambda: lambda x: None)
REGISTRY = {p.name: p for p in (IDENTITY, TOKEN_DROPPER, FIGURE_SHIFTER, SILENT)}


def registry(spark: SparkSession) -> DataFrame:
    """The known producers as a table: name, calls at once, and limits a minute."""
    return spark.createDataFrame([(p.name, p.at_once, p.per_minute, p.tokens_per_minute) for p in REGISTRY.values()], "name string, at_once int, per_minute int, tokens_per_minute int")


_MADE: dict[str, Callable[[str], str | None]] = {}


def _function(p: Producer) -> Callable[[str], str | None]:
    if p.name not in _MADE:
        _MADE[p.name] = p.make()
    return _MADE[p.name]


def produced(df: DataFrame, prompt: str, producer: Producer) -> DataFrame:
    """`df` with answer, a struct (ANSWER) for each row's prompt; a null prompt has a null text, an exception is kept as error.

    Batches are answered `at_once` rows at a time and in order; partitions lie side by side, so the cluster's
    concurrency is at_once times its cores: give fewer partitions for a service with a limit.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", answer struct<{', '.join(x.strip().replace(' ', ':') for x in ANSWER.split(','))}>"
    kind = pa.struct([("text", pa.string()), ("prompt_tokens", pa.int32()), ("completion_tokens", pa.int32()), ("elapsed_ms", pa.int32()), ("model", pa.string()), ("error", pa.string())])

    def one(x: str | None) -> dict:
        began, text, error = time.perf_counter(), None, None
        if x is not None:
            try:
                text = _function(producer)(x)
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        return {"text": text, "prompt_tokens": estimate(x), "completion_tokens": estimate(text) if text else 0, "elapsed_ms": int(1000 * (time.perf_counter() - began)), "model": producer.name, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(producer.at_once) as pool:
            for batch in batches:
                answers = list(pool.map(one, batch.column(prompt).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, kind)], names=[*batch.schema.names, "answer"])

    return df.mapInArrow(run, schema)


def scored(df: DataFrame, source: str, target: str, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], name: str = "score", size: int = 8) -> DataFrame:
    """`df` with a model's score of each pair, in lots of `size`; the model is made once a worker. Pairs with a null have none."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            pairs = list(zip(batch.column(source).to_pylist(), batch.column(target).to_pylist(), strict=True))
            at = [i for i, (s, t) in enumerate(pairs) if s is not None and t is not None]
            out: list[float | None] = [None] * len(pairs)
            for k in range(0, len(at), size):
                model = model or make()
                for i, x in zip(at[k : k + size], model([pairs[i] for i in at[k : k + size]]), strict=True):
                    out[i] = float(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def length_ratio() -> Callable[[list[tuple[str, str]]], list[float]]:
    """An offline stand-in for a learned metric: how near the lengths are."""
    return lambda pairs: [min(len(s), len(t)) / max(len(s), len(t), 1) for s, t in pairs]


@dataclass(frozen=True)
class Stage:
    """A step of a pipeline: from frames by name to frames by name. It is done once its outputs are there."""

    name: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]
    run: Callable[..., dict[str, DataFrame]]
    recoverable: bool = True


def run_stages(frames: dict[str, DataFrame], stages: list[Stage], save: Callable[[str, DataFrame], DataFrame], load: Callable[[str], DataFrame | None]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """All frames after the stages, and (stage, skipped, done or failed). Stages whose outputs `load` finds are skipped.

    A recoverable stage that fails is passed over; any other failure ends the run, after what was done is saved.
    """
    frames, log = dict(frames), []
    for stage in stages:
        there = {w: load(w) for w in stage.writes}
        if all(x is not None for x in there.values()):
            frames.update(there)
            log.append((stage.name, "skipped"))
            continue
        try:
            made = stage.run(*(frames[r] for r in stage.reads))
            frames.update({w: save(w, made[w]) for w in stage.writes})
            log.append((stage.name, "done"))
        except Exception:
            log.append((stage.name, "failed"))
            if not stage.recoverable:
                raise
    return frames, log


def judged(runs: DataFrame, keys: list[str], scores: list[str], errors: str) -> DataFrame:
    """A judge's runs as one judgement a key: the median of each score, and the distinct errors of all runs in order."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *[F.median(F.col(c).cast("double")).alias(c) for c in scores], F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(errors, F.array().cast("array<string>")))))).alias(errors))
