"""Similarity and connections in one matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def boost_scale(sim: DataFrame, n: DataFrame, small: int = 10, floor: float = 0.01, buckets: int = 1000) -> DataFrame:
    """(repo_id, scale): the largest entry of small matrices, else the 95th percentile of all n * n
    entries (diagonal and implicit zeros included); at least ``floor``.

    Two passes over ``sim``, which should be cut: a histogram of each repository's entries tells
    the bucket of the two values that the percentile lies between, and only the entries of these
    buckets are sorted. No matrix is held in one task's memory.
    """
    size = sim.groupBy("repo_id").agg(F.count("*").alias("nnz"), F.max("s").alias("top")).join(n, "repo_id", "right")
    # ranks among the positive entries; the zeros come before them
    rank = 0.95 * (F.col("n").cast("double") * F.col("n") - 1)
    zeros = F.col("n").cast("long") * F.col("n") - F.coalesce("nnz", F.lit(0))
    size = size.select("repo_id", "n", "top", (F.floor(rank) - zeros).alias("lo"), (F.ceil(rank) - zeros).alias("hi"), (rank - F.floor(rank)).alias("part"))
    big = size.where((F.col("n") >= small) & (F.col("hi") >= 0))
    bucket = F.least(F.floor(F.try_divide("s", "top") * buckets), F.lit(buckets - 1)).cast("int")
    placed = sim.select("repo_id", "s").join(big, "repo_id").withColumn("bucket", bucket)
    histogram = placed.groupBy("repo_id", "bucket", "lo", "hi").agg(F.count("*").alias("c"))
    until = F.sum("c").over(Window.partitionBy("repo_id").orderBy("bucket"))
    wanted = histogram.withColumn("before", until - F.col("c")).where(
        ((F.col("lo") >= F.col("before")) & (F.col("lo") < F.col("before") + F.col("c"))) | ((F.col("hi") >= F.col("before")) & (F.col("hi") < F.col("before") + F.col("c")))
    )
    values = placed.select("repo_id", "bucket", "s").join(wanted, ["repo_id", "bucket"]).groupBy("repo_id", "bucket", "before", "lo", "hi", "s").agg(F.count("*").alias("m"))
    end = F.col("before") + F.sum("m").over(Window.partitionBy("repo_id", "bucket").orderBy("s"))
    at = lambda r: (F.col(r) >= F.col("end") - F.col("m")) & (F.col(r) < F.col("end"))
    found = values.withColumn("end", end).groupBy("repo_id").agg(F.max(F.when(at("lo"), F.col("s"))).alias("a"), F.max(F.when(at("hi"), F.col("s"))).alias("b"))
    joined = size.join(found, "repo_id", "left")
    low = F.coalesce("a", F.lit(0.0))
    p95 = low + (F.coalesce("b", F.lit(0.0)) - low) * F.col("part")
    raw = F.when(F.col("n") < small, F.coalesce("top", F.lit(0.0))).otherwise(p95)
    return joined.select("repo_id", F.greatest(F.lit(floor), raw).alias("scale"))


def boosted(sim: DataFrame, graph: DataFrame, scale: DataFrame, boost: float = 1.0) -> DataFrame:
    """S + boost * scale * G with a zero diagonal; absent entries are zeros."""
    g = graph.join(scale, "repo_id").select("repo_id", "i", "j", (F.col("g") * F.col("scale") * boost).alias("s"))
    both = sim.select("repo_id", "i", "j", "s").unionByName(g).groupBy("repo_id", "i", "j").agg(F.sum("s").alias("s"))
    return both.where("i <> j")
