"""Statistics over groups: correlations, agreement, order, percentiles, confusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the complete pairs; null for fewer than three or where one side doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when((F.count(a) >= 3) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


#: Into how many ranges the values of a key are cut, so that no task orders all of them.
RANGES = 1024


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, before, total): each different value of a key, how often it occurs, how many values are less, and how many there are.

    Nulls don't count. Values are counted first and cut into RANGES of equal width; a range's values are ordered by
    themselves, and what lies before a range is added: a key with a third of all rows is spread over many tasks.
    """
    v = F.col(value)
    n = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*keys, v.alias("value")).agg(F.count("*").alias("n"))
    x = F.col("value").cast("double")
    ends = n.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    n = _joined(n, ends, keys).withColumn("_range", F.when(width > 0, F.least(F.lit(RANGES - 1), F.floor((x - F.col("_lo")) / width * RANGES))).otherwise(0).cast("int")).drop("_lo", "_hi")
    sums = n.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*keys)  # RANGES rows a key at most
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_n").over(w)}).drop("_n")
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(n.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))), sums, [*keys, "_range"])
    return out.select(*keys, "value", "n", (F.col("_before") + F.col("_in")).alias("before"), "total")


def _joined(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys meet."""
    names = {k: f"_{k}_" for k in keys}
    small = small.withColumnsRenamed(names)
    on = [big[k].eqNullSafe(small[names[k]]) for k in keys]
    return (big.join(small, on) if on else big.crossJoin(small)).drop(*names.values())


def with_ranks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`df` with rank_<column>, from 1, ties sharing the mean of their ranks; nulls have none."""
    for c in columns:
        ranks = counted(df, keys, c).select(*keys, F.col("value").alias(f"_{c}"), (F.col("before") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))
        ranks = ranks.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        df = df.join(ranks, [df[c] == ranks[f"_{c}"], *(df[k].eqNullSafe(ranks[f"_k_{k}"]) for k in keys)], "left").drop(f"_{c}", *(f"_k_{k}" for k in keys))
    return df


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    """Rank correlation of the complete pairs of each key."""
    ranked = with_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, [x, y])
    return ranked.groupBy(*keys).agg(pearson(F.col(f"rank_{x}"), F.col(f"rank_{y}")).alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], nearest: bool = False) -> DataFrame:
    """(keys, n, names of `at`): exact quantiles of each key by name, interpolated between neighbours, or with `nearest` the
    value at rank round(p * (n - 1)), halves to the even one. A key without values has n 0 and nulls."""
    rows = counted(df, keys, value)
    x, last = F.col("value").cast("double"), F.col("total") - 1

    def one(p: float) -> Column:
        place = F.lit(p) * last
        low, high = (F.bround(place), F.bround(place)) if nearest else (F.floor(place), F.ceil(place))
        is_at = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
        # only the two values around the place say anything
        a, b = F.max(F.when(is_at(low), x)), F.max(F.when(is_at(high), x))
        return a + (b - a) * (F.max(place) - F.max(low))

    found = rows.groupBy(*keys).agg(F.max("total").alias("n"), *[one(p).alias(name) for name, p in at.items()])
    everyone = df.select(*keys).distinct().withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [found[k].eqNullSafe(everyone[f"_k_{k}"]) for k in keys]
    out = everyone.join(found, on, "left")
    return out.select(*[F.col(f"_k_{k}").alias(k) for k in keys], F.coalesce("n", F.lit(0)).alias("n"), *at)


def krippendorff(df: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """Krippendorff's alpha for interval values of each key, by sums of values and squares.

    Units with one value don't count; alpha is null where the values don't differ at all.
    """
    v = F.col(value).cast("double")
    units = df.where(v.isNotNull()).groupBy(*keys, unit).agg(F.count("*").alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).where("m >= 2")
    apart = F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1))
    n, s, q = F.sum("m"), F.sum("s"), F.sum("q")
    expected = 2 * (n * q - s * s) / (n * (n - 1))
    return units.groupBy(*keys).agg((1 - F.try_divide(apart / n, expected)).alias("alpha"), n.alias("n_values"))


def inversions(b: np.ndarray) -> int:
    """How many pairs of a sequence stand in the wrong order, by merging."""
    total, width, n = 0, 1, len(b)
    b = b.copy()
    while width < n:
        for lo in range(0, n - width, 2 * width):
            mid, hi = lo + width, min(lo + 2 * width, n)
            left, right = b[lo:mid], b[mid:hi]
            total += int((len(left) - np.searchsorted(left, right, "right")).sum())
            b[lo:hi] = np.sort(b[lo:hi], kind="stable")
        width *= 2
    return total


def kendall(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau of two orders without ties of each key's items; 1 for one item.

    The items of a key come together in one row, so a key should be a text or a document; inversions are counted by
    merging, in n log n and not over all pairs.
    """
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b")))).alias("_ab"))
    lists = lists.select(*keys, F.size("_ab").cast("bigint").alias("n"), F.transform("_ab", lambda x: x["b"].cast("bigint")).alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tau = []
            for x in batch.column("_b").to_pylist():
                n = len(x)
                tau.append(1.0 if n < 2 else 1 - 4.0 * inversions(np.array(x)) / (n * (n - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tau, pa.float64())], names=[*batch.schema.names[:-1], "tau"])

    kinds = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    return lists.mapInArrow(run, f"{kinds}, n bigint, tau double")


def confusion(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Counts and precision, recall, F1 and accuracy of two boolean columns; rows with a null don't count."""
    d = df.where(gold.isNotNull() & predicted.isNotNull())
    d = d.agg(
        F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"),
        F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn"),
    )
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return d.withColumns({"precision": p, "recall": r}).withColumns(
        {"f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))}
    )


def medians(df: DataFrame, keys: list[str], columns: list[str], places: int = 6) -> DataFrame:
    """How many runs each key has and the median of each column over them; nulls don't count."""
    return df.groupBy(*keys).agg(F.count("*").alias("runs"), *[F.round(F.median(F.col(c).cast("double")), places).alias(c) for c in columns])


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """The sum of columns by their weights; null if one of them is."""
    out = F.lit(0.0)
    for c, w in parts:
        out = out + c * w
    return out


def share(part: Column, whole: Column, places: int = 2) -> Column:
    """`part` per cent of `whole`; null and not 100 where there is nothing to have a part of."""
    return F.round(F.when(whole > 0, 100.0 * part / whole), places)
