"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import docpairs, packing, quality, syntax
from shelfmark.llm.credentials import Credentials
from shelfmark.llm.leakage import LeakSearch
from shelfmark.llm.neardup import NearDuplicates
from shelfmark.llm.provenance import Provenance
from shelfmark.llm.truncation import Truncation
from shelfmark.runtime import cut, table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repo_files")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = NearDuplicates(_files(spark, d), "file_id", "content", shingle=3, threshold=0.7, min_words=40)
    return near.pairs().select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Default near-duplicate parameters, five words and a similarity of 0.8; every text has a class, however short."""
    near = NearDuplicates(_files(spark, d), "file_id", "content", min_words=0)
    return near.groups().select(F.col("id").alias("file_id"), F.col("root").alias("group_id"), "n_links")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return Truncation(_files(spark, d)).found()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return Truncation(_files(spark, d)).rates()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return Credentials(_files(spark, d)).lines()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return Credentials(_files(spark, d)).redact()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(_files(spark, d)).select("file_id", "func_name").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(_files(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return Provenance(_files(spark, d)).foreign()


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return Provenance(_files(spark, d)).labels()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(_files(spark, d))


def p6_errors(spark: SparkSession, d: str) -> DataFrame:
    return syntax.verdicts(_files(spark, d)).where("n_errors > 0")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(_files(spark, d))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", packing.token_count("text").alias("tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(_sized(spark, d), "doc_id", "tokens", 2048)
    return packed.where("n_pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """An assignment for every container, sizes as TESTDATA.md counts tokens."""
    sized, parts = cut(_sized(spark, d)), []
    kinds = table(spark, d, "containers").select("container", "capacity_tokens").distinct().orderBy("container").limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers: pack them in parts")
    for c in kinds:
        parts.append(packing.pack(sized, "doc_id", "tokens", c["capacity_tokens"]).select(F.lit(c["container"]).alias("container"), F.col("id").alias("doc_id"), "piece", "n_pieces", "tokens", "window"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def p7_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Training windows of 2,048 tokens of a public byte-level BPE tokenizer."""
    count = F.pandas_udf(packing.bpe_counter(), T.LongType())
    sized = table(spark, d, "documents").select("doc_id", count("text").alias("tokens"))
    return packing.pack(sized, "doc_id", "tokens", 2048).select(F.col("id").alias("doc_id"), "piece", "n_pieces", "tokens", "window")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(_sized(spark, d), "doc_id", "tokens", 2048), 2048)


def _leaks(spark: SparkSession, d: str) -> LeakSearch:
    return LeakSearch(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).leaks()


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).matches()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.graded(quality.statistics(table(spark, d, "documents"))).where("not_prose").select("doc_id")


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.graded(quality.statistics(table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_groups, p2_found, p2_rates, p3_found, p3_redacted, p4_found, p4_pairs, p5_found, p5_labels, p6_found, p6_errors, p6_rates,
            p7_found, p7_windows, p7_bpe, p7_fill, p8_found, p8_matches, p9_found, p9_stats,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
WITH w AS (SELECT file_id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS t FROM repo_files WHERE content IS NOT NULL),
s AS (SELECT DISTINCT file_id, hash(t[k], t[k + 1], t[k + 2]) AS h FROM (SELECT file_id, t, unnest(range(1, len(t) - 1)) AS k FROM w WHERE len(t) >= 40)),
n AS (SELECT file_id, count(*) AS n FROM s GROUP BY file_id),
c AS (SELECT a.file_id AS x, b.file_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.file_id < b.file_id GROUP BY 1, 2)
SELECT x AS file_id_a, y AS file_id_b FROM c JOIN n p ON p.file_id = x JOIN n q ON q.file_id = y WHERE c >= 0.7 * (p.n + q.n - c) - 1e-9""",
        "p7_found": r"""
SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) > 2048""",
    }
