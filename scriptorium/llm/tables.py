"""The domain's tables as the operators read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources import table

#: A dimension of at most this many rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


#: Rows that one task of a join of texts gets, about.
ROWS_A_TASK = 50_000


def joined(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Inner join that broadcasts `small` only if a count shows it to be small enough."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on)
    return big.join(small, on)


def width(spark: SparkSession) -> int:
    """In how many parts work in Python is cut at least: small shuffles would be joined to a few large tasks else."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out anew if it comes in fewer parts than there are cores; a large table stays as it is read."""
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(width(spark))


def translated(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Translations with src_text or src_plain of their unit and the job's language.

    Repeated rows of a translation stay, as results are made distinct where they are a few integers a row.
    """
    tgt = [c for c in columns if c.startswith("tgt_") or c == "status"]
    src = [c for c in columns if c.startswith("src_")]
    t = table(spark, sf_dir, "translations").where(F.col("status") != "pending")
    t = t.select(F.col("id").alias("row_id"), "job_id", "unit_id", *tgt)
    u = table(spark, sf_dir, "translation_units").select(F.col("id").alias("unit_id"), *src)
    j = table(spark, sf_dir, "translation_jobs").select(F.col("id").alias("job_id"), F.col("language").alias("lang"))
    # both sides are dealt out by the join's key, so the join adds no shuffle; the number of parts grows with the table
    n = max(width(spark), -(-table(spark, sf_dir, "translations").count() // ROWS_A_TASK))
    return joined(t, j, "job_id").repartition(n, "unit_id").join(u.repartition(n, "unit_id"), "unit_id")
