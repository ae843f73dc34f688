"""Shared parts: language of a row, words, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import cut

# Endings of paths and the language they tell.
ENDINGS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go",
    "c": "c", "h": "c", "cs": "c#", "rb": "ruby", "json": "json", "yaml": "yaml", "yml": "yaml",
    "md": "markdown", "txt": "text", "env": "text", "ini": "ini", "cfg": "ini", "sh": "shell",
    "bash": "shell", "html": "html", "htm": "html",
}


def language_of(language: str | None, path: str | None) -> str:
    """Lower-case language of a row; the path's ending tells it where ``language`` is null."""
    if language is not None:
        return language.strip().lower()
    name = (path or "").rsplit("/", 1)[-1]
    return ENDINGS.get(name.rsplit(".", 1)[-1].lower(), "") if "." in name else ""


def language_column() -> Column:
    """The same as :func:`language_of`, as an expression over ``language`` and ``path``."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    by_end = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    return F.coalesce(F.lower(F.trim("language")), F.try_element_at(by_end, ending), F.lit(""))


def small_side(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` to join with: broadcast if it has at most ``most`` rows, else shuffled like any table."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Connected components of an undirected edge table (a, b), as (id, root).

    Alternates large-star and small-star steps, so no component is ever gathered in
    one task beyond its neighbours' minimum; each round is written to the shared
    checkpoint folder. It ends when every id has one edge, to a root without one; rounds grow
    with the logarithm of the number of ids, and more than ``most_rounds`` of them raise an error.
    ``root`` is the smallest id of the component. Self-edges and nulls are dropped; isolated
    ids do not come out.
    """
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    e = cut(e.where("u <> v").distinct())
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u move to the least neighbour
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small star: each node hands its smaller neighbours to the least of them
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
    raise RuntimeError(f"components are not found after {most_rounds} rounds")
