"""Session helpers: sessions for tests, table reading, durable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "shelfmark") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHELFMARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors (spark.checkpoint.dir).

    Only a local session that names none, as in tests, gets a folder of this machine; on a
    cluster that is an error. Files of a checkpoint go when nothing refers to it any more.
    """
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='shelfmark-')}")
        jsc.conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the shared folder: later readers never recompute it,
    also when executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to join with: sent to all tasks if it has at most ``most`` rows, else shuffled like any table."""
    return F.broadcast(df) if df.count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
