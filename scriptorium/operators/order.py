"""Operators that depend on order: latest rows, first rows, running caps, batches, neighbours, ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`. Give an order without ties, else any of the first rows is taken."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_wins(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Rows whose key wasn't met before in `order`; a null key is a key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def running(df: DataFrame, keys: list[str], order: list[Column], size: Column, block: Column, name: str = "running") -> DataFrame:
    """`df` with the sum of `size` up to each row of its key.

    `block` must not fall along `order`, as a row's number divided by a thousand doesn't: blocks are summed first, and what
    lies before a block is added to the sums within it, so that no window holds a whole key.
    """
    d = df.withColumn("_block", block)
    sums = d.groupBy(*keys, "_block").agg(F.sum(size).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.withColumn("_in", F.sum(size).over(inside)).join(sums, [*keys, "_block"])
    return out.withColumn(name, F.col("_before") + F.coalesce("_in", F.lit(0))).drop("_block", "_before", "_in")


def within_cap(df: DataFrame, keys: list[str], order: list[Column], size: Column, cap: float, block: Column | None = None) -> DataFrame:
    """The longest prefix of each key's rows whose sizes add up to `cap` at most; `block` as in `running`."""
    return running(df, keys, order, size, F.lit(0) if block is None else block, "_sum").where(F.col("_sum") <= cap).drop("_sum")


def occurrence(df: DataFrame, keys: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """A running number from 0 of the rows of each key, so that repeated items become distinct."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def batches(df: DataFrame, keys: list[str], order: str, text: str, count: int = 30, chars: int = 10_000, tokens: int = 5_000, block: Column | None = None) -> DataFrame:
    """`df` with batch, the number from 0 of the batch a row falls into.

    Three limits nest: rows, then letters, then estimated tokens (half the letters). A row beyond a limit alone
    is a batch of its own. The first limit is arithmetic on the ordinal; the others are a fold over the at most
    `count` rows of one chunk, so no group grows with the data. `block` as in `running`.
    """
    rows = running(df, keys, [F.asc(order)], F.lit(1), F.lit(0) if block is None else block, "_n")
    rows = rows.withColumn("_chunk", F.floor((F.col("_n") - 1) / count).cast("int")).drop("_n")
    n = F.coalesce(F.length(text), F.lit(0))
    item = F.struct(F.col(order).alias("o"), n.cast("int").alias("n"), F.greatest(F.lit(1), F.floor(n * 0.5).cast("int")).alias("t"))
    zero = F.struct(F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("k"), F.expr("cast(array() as array<struct<o:int,b:int>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new_chars = (s["c"] > 0) & (s["c"] + x["n"] > chars)
        new_tokens = (s["k"] > 0) & (s["k"] + x["t"] > tokens)
        new = new_chars | new_tokens
        b = F.when(new, s["b"] + 1).otherwise(s["b"])
        return F.struct(
            b.alias("b"), F.when(new_chars, x["n"]).otherwise(s["c"] + x["n"]).alias("c"),
            F.when(new, x["t"]).otherwise(s["k"] + x["t"]).alias("k"), F.concat(s["out"], F.array(F.struct(x["o"].cast("int").alias("o"), b.alias("b")))).alias("out"),
        )

    folded = rows.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    folded = folded.select(*keys, "_chunk", F.explode(F.aggregate("_items", zero, step, lambda s: s["out"])).alias("_p"))
    folded = folded.select(*keys, "_chunk", F.col("_p.o").alias(order), F.col("_p.b").alias("_b"))
    # batches of earlier chunks count first
    ends = folded.groupBy(*keys, "_chunk").agg((F.max("_b") + 1).alias("_n"))
    ends = running(ends, keys, [F.asc("_chunk")], F.col("_n"), F.floor(F.col("_chunk") / 1000), "_upto").select(*keys, "_chunk", (F.col("_upto") - F.col("_n")).alias("_before"))
    numbered = folded.join(ends, [*keys, "_chunk"]).select(*keys, order, (F.col("_before") + F.col("_b")).cast("int").alias("batch"))
    return df.join(numbered, [*keys, order])


def neighbours(df: DataFrame, keys: list[str], order: list[Column], column: str, block: Column | None = None) -> DataFrame:
    """`df` with previous and following, the column's value in the row before and after; `block` as in `running`."""
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({"previous": F.lag(column).over(w), "following": F.lead(column).over(w)})
    d = df.withColumn("_block", block)
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    d = d.withColumns({"_n": F.row_number().over(w), "_p": F.lag(column).over(w), "_f": F.lead(column).over(w)})
    # the first and last rows of a block look into the blocks beside it
    count = Window.partitionBy(*keys, "_block")
    d = d.withColumn("_size", F.count("*").over(count))
    ends = d.groupBy(*keys, "_block").agg(F.max(F.when(F.col("_n") == 1, F.struct(F.col(column).alias("v")))).alias("_first"), F.max(F.when(F.col("_n") == F.col("_size"), F.struct(F.col(column).alias("v")))).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.select(*keys, "_block", F.lag("_last").over(along)["v"].alias("_before"), F.lead("_first").over(along)["v"].alias("_after"))
    out = d.join(ends, [*keys, "_block"])
    previous = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_p"))
    following = F.when(F.col("_n") == F.col("_size"), F.col("_after")).otherwise(F.col("_f"))
    return out.withColumns({"previous": previous, "following": following}).drop("_block", "_n", "_size", "_p", "_f", "_before", "_after")


def listed(values: Column, order: Column) -> Column:
    """An aggregate: the values in order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda x: x["v"])
