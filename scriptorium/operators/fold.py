"""Ordered folds: what each row gets depends on a state that the rows before it leave behind.

A key's rows come one after another through one task and none are held, so a hot key costs time but no memory; keys lie
side by side. Null keys are one key. Steps see plain Python values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(df: DataFrame, keys: list[str], order: list[Column], reads: list[str], adds: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """`df` with the columns `adds` (a schema string). `step(state, *values of reads)` gives the next state and a tuple for `adds`."""
    names = [c.strip().split()[0] for c in adds.split(",")]
    kinds = [f.dataType for f in df.sparkSession.createDataFrame([], adds).schema]
    ready = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            ks = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for k, values in zip(ks, zip(*(batch.column(c).to_pylist() for c in reads), strict=True), strict=True):
                if state is None or k != now:
                    now, state = k, start()
                state, got = step(state, *values)
                out.append(got)
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, arrow, strict=True))], names=[*batch.schema.names, *names])

    schema = ", ".join(f"`{c}` {t}" for c, t in ready.dtypes)
    return ready.mapInArrow(run, f"{schema}, {adds}")


def chunked(df: DataFrame, keys: list[str], order: list[Column], size: str, limit: int, most: int | None = None) -> DataFrame:
    """`df` with chunk, from 0: a chunk is filled up to `limit`, a row beyond it alone is a chunk; rows after `most` chunks are left out."""

    def step(state, n):
        chunk, held = state
        n = n or 0
        if held and held + n > limit:
            chunk, held = chunk + 1, 0
        return (chunk, held + n), (chunk,)

    out = folded(df, keys, order, [size], "chunk int", lambda: (0, 0), step)
    return out if most is None else out.where(F.col("chunk") < most)
