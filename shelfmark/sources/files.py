"""File tables: nested and flat form, readers, validation, result sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import normal_path
from shelfmark.runtime import cut

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("content", T.StringType())])
NESTED = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("files", T.ArrayType(FILE))])
REQUIRED = ("repo_id", "path", "language", "content")


def read_repositories(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A dataset of repositories, nested (column ``files``) or flat, from parquet, json or orc."""
    reader = spark.read.schema(NESTED) if format == "json" else spark.read
    return flat(reader.format(format).load(path))


def read_tree(spark: SparkSession, root: str, language_of_ending: dict[str, str] | None = None, encoding: str = "UTF-8", decode_error: str = "strict") -> DataFrame:
    """Files of a directory tree ``root/repo/...`` as a flat table; the ending tells the language.

    Bytes that ``encoding`` does not know raise an error (strict), leave a replacement character
    (replace) or make the content null (null).
    """
    if decode_error not in ("strict", "replace", "null"):
        raise ValueError("decode_error is strict, replace or null")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the file system tells paths as addresses with one or three slashes
    bare = re.escape("/" + root.split(":", 1)[-1].strip("/"))
    parts = [F.regexp_extract("path", rf"{bare}/([^/]+)(/.*)$", k) for k in (1, 2)]
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in (language_of_ending or {}).items() for x in kv]) if language_of_ending else None
    language = F.try_element_at(known, ending) if known is not None else F.lit(None).cast("string")
    if encoding.upper() in ("UTF-8", "UTF8"):
        text = F.col("content").cast("string")
        good = F.is_valid_utf8(text)
        content = {"strict": F.validate_utf8(text), "replace": F.make_valid_utf8(text), "null": F.when(good, text)}[decode_error]
    else:
        content = F.decode("content", encoding)
        if decode_error == "null":
            content = F.when(F.encode(content, encoding) == F.col("content"), content)
    return raw.select(parts[0].alias("repo_id"), parts[1].alias("path"), language.alias("language"), content.alias("content"))


def flat(df: DataFrame) -> DataFrame:
    """One row per file; nested input is exploded, its other columns pass through."""
    if "files" in df.columns:
        df = df.withColumn("file", F.explode("files")).select(*[c for c in df.columns if c != "files"], "file.*")
    return validated(df)


def nested(files: DataFrame) -> DataFrame:
    """One row per repository with its files in path order.

    For export only: an array holds a whole repository, so its size bounds the row.
    """
    rest = [c for c in files.columns if c != "repo_id"]
    return files.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("path", *[c for c in rest if c != "path"]))).alias("files"))


def validated(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"file table lacks {', '.join(missing)}")
    return df


def positions(keys: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``keys`` with ``idx``, the place in its group, and ``n_files``, the size of the group.

    Rows are sorted in ranges over all groups, so a group of any size is numbered by as many
    tasks as it fills; what comes before a range is added from one row per range and group.
    """
    by = [*group, *order]
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = cut(keys.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys.columns, F.spark_partition_id().alias("part_"), at.alias("at_")))
    ranges = rows.groupBy(*group, "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("c_"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("c_").over(w.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*[F.col(c).alias(f"g_{c}") for c in group], F.col("part_").alias("p_"), (before - F.col("first_")).alias("shift_"), F.sum("c_").over(w).cast("int").alias("n_files"))
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in group]
    joined = rows.join(ranges, [F.col("part_") == F.col("p_"), *same])
    return joined.select(*keys.columns, (F.col("at_") + F.col("shift_")).cast("int").alias("idx"), "n_files")


def keyed(files: DataFrame, tie: str | None = None) -> tuple[DataFrame, list[str]]:
    """Files with normal paths, and the columns that tell their rows apart.

    These are ``tie`` or ``file_id``, which must be unique; without it the path, a digest of
    the content and, of repeated rows, a number.
    """
    f = validated(files).withColumn("path", normal_path())
    tie = tie or ("file_id" if "file_id" in f.columns else None)
    if tie:
        return f, [tie]
    f = f.withColumn("digest_", F.coalesce(F.md5("content"), F.lit("")))
    again = F.row_number().over(Window.partitionBy("repo_id", "path", "digest_").orderBy("digest_"))
    return f.withColumn("again_", again), ["repo_id", "path", "digest_", "again_"]


def with_keys(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the further columns of ``keys``; an equi-join on keys that are even, whatever the
    sizes of repositories. Rows meet a hash table of their share of the keys, so contents are
    neither sorted nor, where a table lies in few splits, left to as few tasks."""
    more = [c for c in keys.columns if c not in by and c not in rows.columns]
    k = keys.select(*[F.col(c).alias(f"k_{c}") for c in by], *more).hint("shuffle_hash")
    joined = rows.join(k, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in by] if len(by) > 1 else F.col(by[0]) == F.col(f"k_{by[0]}"))
    return joined.select(*rows.columns, *more)


def presorted(files: DataFrame, tie: str | None = None) -> DataFrame:
    """Normal paths, ``idx`` in path order per repository (code points), ``n_files``.

    Rows of one path are ordered by ``tie`` (file_id where there is one, else a digest of the
    content); repeated rows get positions of their own. Only keys are sorted and numbered, and
    joined to the contents by row.
    """
    f, by = keyed(files, tie)
    keys = positions(f.select("repo_id", "path", *[c for c in by if c not in ("repo_id", "path")]), ["repo_id"], ["path", *[c for c in by if c not in ("repo_id", "path")]])
    return with_keys(f, keys, by).drop("digest_", "again_")


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, drawn with replacement by a fixed rule from ``seed``; none of an empty table.

    Rows are numbered in the order of ``key``, which must be unique; draws are joined by number.
    """
    keys = positions(df.select(key).withColumn("all_", F.lit(0)), ["all_"], [key])
    total = keys.agg(F.max("n_files")).first()[0] or 0
    mixed = ((F.col("id") + seed) * 48271 % 2147483647) * 69621 % 2147483647
    draws = df.sparkSession.range(1, n + 1 if total else 1).select((mixed % max(total, 1)).alias("idx"))
    return df.join(draws.join(keys.select(key, "idx"), "idx").drop("idx"), key).select(*df.columns)


def write_result(result: DataFrame, path: str, matching_scores: bool = True, format: str = "parquet") -> None:
    """The ordered files, with or without their scores; see also plans.ordering.Ordering.write."""
    (result if matching_scores else result.drop("matching_score")).write.mode("errorifexists").format(format).save(path)
