"""The review gate: which units a person should look at, and how urgently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(df: DataFrame, fps: float = 0.95, xcomet: float = 0.25, judge: float = 3.0) -> DataFrame:
    """`df` with reasons, flag and risk.

    Reads is_fallback, fps_unit, xcomet_score and the optional rubric_score, geval_score and error_drifts (an
    array). A null signal gives no reason. Risk is that of the worst reason, 0 without any.
    """

    def reason(when: Column, key: str, risk: Column | float) -> Column:
        r = risk if isinstance(risk, Column) else F.lit(risk)
        return F.when(when, F.struct(F.lit(key).alias("key"), r.cast("double").alias("risk")))

    f, x = F.col("fps_unit").cast("double"), F.col("xcomet_score").cast("double")
    found = [
        reason(F.coalesce(F.col("is_fallback"), F.lit(False)), "fallback", 1.0),
        reason(f < fps, "fps", 1.0 - f),
        reason(x < xcomet, "xcomet", F.least(F.lit(1.0), (xcomet - x) / max(xcomet, 1e-6))),
    ]
    for name in ("rubric", "geval"):
        if f"{name}_score" in df.columns:
            j = F.col(f"{name}_score").cast("double")
            found.append(reason(j < judge, name, (judge - j) / 5.0))
    if "error_drifts" in df.columns:
        found.append(reason(F.size(F.coalesce("error_drifts", F.array().cast("array<string>"))) > 0, "fact_drift", 1.0))
    reasons = F.filter(F.array(*found), lambda r: r.isNotNull())
    return df.withColumn("_r", reasons).withColumns(
        {"reasons": F.transform("_r", lambda r: r["key"]), "flag": F.size("_r") > 0, "risk": F.coalesce(F.array_max(F.transform("_r", lambda r: r["risk"])), F.lit(0.0))}
    ).drop("_r")


def allocation(pools: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """(key, allocated): `n` samples shared out in proportion to the pools, by largest remainders.

    No pool gives more than it has; if all have at most `n` together, all is taken. Equal remainders go to the
    lower key first. Floors never exceed a pool, and only pools with a remainder get one more, so one round does.
    """
    exact = F.lit(float(n)) * F.col(size) / F.col("_total")
    whole = F.broadcast(pools.agg(F.sum(size).alias("_total")))  # one row
    d = pools.join(whole, F.lit(True)).withColumn("_floor", F.floor(exact).cast("bigint")).withColumn("_rest", F.round(exact - F.col("_floor"), 9))
    missing = F.broadcast(d.agg((F.lit(n) - F.sum("_floor")).alias("_missing")))  # one row
    # floors fall short of n by less than n, so the n largest remainders are enough, and only they are ranked
    first = d.where(F.col("_floor") < F.col(size)).orderBy(F.desc("_rest"), key).limit(n)
    first = first.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_rest"), key))).join(missing, F.lit(True)).where(F.col("_rank") <= F.col("_missing")).select(F.col(key).alias("_k"), F.lit(1).alias("_extra"))
    d = d.join(first, F.col(key).eqNullSafe(F.col("_k")), "left")
    got = F.when(F.col("_total") <= n, F.col(size)).otherwise(F.col("_floor") + F.coalesce("_extra", F.lit(0)))
    return d.select(key, got.cast("bigint").alias("allocated"))


def draw(rows: DataFrame, key: str, row_id: str, allocated: DataFrame, seed: int) -> DataFrame:
    """The allocated number of rows of each key, in the order of a seeded hash of their id."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order, row_id)))
    return r.join(allocated, key).where(F.col("_r") <= F.col("allocated")).drop("_r", "allocated")


def fails(xcomet: Column, fps: Column, failed_claim: Column, least_xcomet: float = 0.25, least_fps: float = 0.95) -> Column:
    """Whether a unit is to be refined: any score below its threshold, or a claim that failed; null scores say nothing."""
    return F.coalesce(xcomet.cast("double") < least_xcomet, F.lit(False)) | F.coalesce(fps.cast("double") < least_fps, F.lit(False)) | F.coalesce(failed_claim, F.lit(False))


def refined(passes: DataFrame, score: str, least: float, rounds: int, produce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All passes with is_fallback after at most `rounds` rounds: what scores below `least` is produced anew as the next pass.

    `produce` takes the failing rows and gives rows with the same columns. What still fails after the last round is a
    fallback. The plan grows by `rounds` steps, whatever the data.
    """
    done = passes.withColumn("is_fallback", F.lit(False))
    failing = passes.where(F.col(score) < least)
    for n in range(rounds):
        new = produce(failing).withColumn("pass_no", F.col("pass_no") + 1)
        still = F.coalesce(F.col(score) < least, F.lit(False))
        done = done.unionByName(new.withColumn("is_fallback", still if n == rounds - 1 else F.lit(False)))
        failing = new.where(still)
    return done


def edited(edits: DataFrame, passes: DataFrame) -> DataFrame:
    """`edits` (job_id, unit_id, ...) as new passes: pass_no one above the highest of their unit, status refined; edits of unknown units are left out."""
    top = passes.groupBy("job_id", "unit_id").agg(F.max("pass_no").cast("int").alias("_top"))
    return edits.join(top, ["job_id", "unit_id"]).withColumns({"pass_no": F.col("_top") + 1, "status": F.lit("refined")}).drop("_top")
