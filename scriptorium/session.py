"""Session factory and the rules for cutting lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "scriptorium", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted session is returned as it is."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        # checkpoints go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.compress", "true")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that a lost executor doesn't recompute it.

    The folder is the one the session names in spark.checkpoint.dir. Only a session that names none, as in
    tests, gets a folder of its own on this machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="scriptorium-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
