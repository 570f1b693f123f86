"""Choosing rows for a corpus: each once under its first group, and at most so many of a kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.fold import folded


def cross_listed(df: DataFrame, item: str, group: str, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """(group, item): every item under the first of `groups` it is listed under, the first `n` of each group.

    An item counts for its first group even if that group is full already; a gatherer that stops early would let the
    next group have it. Other groups' rows are left out.
    """
    place = F.array_position(F.array(*map(F.lit, groups)), F.col(group))
    first = df.withColumn("_place", place).where("_place > 0").withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy("_place", *order))).where("_r = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).select(group, item)


def capped(df: DataFrame, group: str, kind: str, wanted: str, order: list[Column], total: int, cap: int, quota: int) -> DataFrame:
    """The rows a greedy reader takes from each group: first `quota` of those `wanted`, then any, up to `total`, at most `cap` a kind.

    What is taken changes what may be taken after it, so a group's rows are read in order, `wanted` ones first; of each
    kind no more than the first `cap` of either sort can ever be taken, so only these are read.
    """
    few = df.withColumn("_k", F.row_number().over(Window.partitionBy(group, kind, wanted).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    # each row is met twice: among the wanted, and among all
    met = few.withColumn("_i", rank).withColumn("_round", F.explode(F.when(F.col(wanted), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))

    def step(state, i, this, k):
        taken, kinds = state
        ok = i not in taken and kinds.get(k, 0) < cap and len(taken) < (quota if this == 0 else total)
        if ok:
            taken.add(i)
            kinds[k] = kinds.get(k, 0) + 1
        return (taken, kinds), (ok,)

    out = folded(met, [group], [F.asc("_round"), F.asc("_i")], ["_i", "_round", kind], "_taken boolean", lambda: (set(), {}), step)
    return out.where("_taken").drop("_i", "_round", "_taken")
