"""An extension: repositories are ordered again as deliveries of their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.ordering import order_files


def reorder_changed(batch: DataFrame, stored: DataFrame, **options) -> DataFrame:
    """The new order of every repository of a micro-batch: its stored files, the last delivery
    of each path (by ingested_at, then file_id), in one table."""
    changed = batch.select("repo_id").distinct()
    both = stored.join(changed, "repo_id", "left_semi").unionByName(batch)
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), F.col("path")))
    latest = both.withColumn("path", path).groupBy("repo_id", "path").agg(F.max_by(F.struct("file_id", "language", "content"), F.struct("ingested_at", "file_id")).alias("f"))
    return order_files(latest.select("repo_id", "path", "f.*"), **options)


def start(spark: SparkSession, folder: str, stored: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """Watch ``folder`` for parquet deliveries; ``sink`` gets each batch's new orders."""
    schema = stored().schema
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: sink(reorder_changed(df, stored(), **options), n)).start()
