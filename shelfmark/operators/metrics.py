"""How well an order follows the connections between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjacent(ordered: DataFrame) -> DataFrame:
    """(repo_id, pos, from_file, to_file): each file and the one after it, without leading slashes."""
    w = Window.partitionBy("repo_id").orderBy("pos")
    bare = F.ltrim(F.col("path"), F.lit("/"))
    return ordered.select("repo_id", "pos", bare.alias("from_file"), F.lead(bare).over(w).alias("to_file")).where("to_file is not null")


def connection_metrics(ordered: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, n_files, n_connections, jaccard, recall, connection_score).

    ``n_connections`` counts all rows of edges, repeated ones too. A repository of one file has
    null metrics, one without connections a null score; one without files gives no row.
    """
    size = ordered.groupBy("repo_id").agg(F.count("*").cast("int").alias("n_files"))
    links = edges.select("repo_id", F.ltrim(F.col("from_file"), F.lit("/")).alias("from_file"), F.ltrim(F.col("to_file"), F.lit("/")).alias("to_file"))
    n = links.groupBy("repo_id").agg(F.count("*").cast("int").alias("n_connections"))
    steps = adjacent(ordered).select("repo_id", "from_file", "to_file").distinct().withColumn("a", F.lit(1))
    both = steps.join(links.distinct().withColumn("b", F.lit(1)), ["repo_id", "from_file", "to_file"], "full")
    sets = both.groupBy("repo_id").agg(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).alias("common"), F.count("*").alias("all"))
    j = size.join(n, "repo_id", "left").join(sets, "repo_id", "left").fillna({"n_connections": 0, "common": 0})
    many = F.col("n_files") > 1
    recall = F.col("common") / F.nullif(F.col("n_files") - 1, F.lit(0))
    score = F.when(many & (F.col("n_connections") > 0), F.greatest(recall, F.col("common") / F.nullif(F.col("n_connections"), F.lit(0))))
    return j.select("repo_id", "n_files", "n_connections", F.when(many, F.col("common") / F.col("all")).alias("jaccard"), F.when(many, recall).alias("recall"), score.alias("connection_score"))


def matching_scores(ordered: DataFrame, sim: DataFrame) -> DataFrame:
    """ordered(repo_id, pos, idx, ...) with matching_score: S from each file to the next; the last
    file has the score back to the one before. Absent entries are 0."""
    w = Window.partitionBy("repo_id").orderBy("pos")
    o = ordered.withColumn("j", F.coalesce(F.lead("idx").over(w), F.lag("idx").over(w)))
    s = sim.select("repo_id", F.col("i").alias("idx"), "j", F.col("s").alias("matching_score"))
    return o.join(s, ["repo_id", "idx", "j"], "left").withColumn("matching_score", F.when(F.col("j").isNotNull(), F.coalesce("matching_score", F.lit(0.0)))).drop("j")


def coherence(scored: DataFrame) -> DataFrame:
    """(repo_id, coherence_score): the median of the matching scores."""
    return scored.groupBy("repo_id").agg(F.median("matching_score").alias("coherence_score"))
