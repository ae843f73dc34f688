"""The whole plan: files of all repositories in, ordered files out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.stopwords import shipped
from shelfmark.operators import bm25, imports, metrics
from shelfmark.operators.solver import ORDER, orderer
from shelfmark.runtime import cut
from shelfmark.sources.files import flat, keyed, positions, with_keys

MAX_REPO_SIZE = 10_000


def gated(files: DataFrame, max_repo_size: int = MAX_REPO_SIZE) -> DataFrame:
    """Presorted files with ``gate``: whether the repository is worth ordering at all."""
    return files.withColumn("gate", (F.col("n_files") > 1) & (F.col("n_files") <= max_repo_size))


def conditions(files: DataFrame) -> DataFrame:
    """(repo_id, n_files, gate, no_content, no_graph): what analysis a repository admits.

    A null content stops the content analysis of its repository; a null content of a Python file,
    or a null language beside others, stops its import analysis.
    """
    f = files if "null_" in files.columns else files.withColumn("null_", F.col("content").isNull())
    null = F.col("null_")
    return f.groupBy("repo_id", "n_files", "gate").agg(
        F.max(null.cast("int")).cast("boolean").alias("no_content"),
        (F.max((null & (F.col("language") == "Python")).cast("int")).eqNullSafe(1) | (F.max(F.col("language").isNull().cast("int")).eqNullSafe(1) & (F.max(F.col("language").isNotNull().cast("int")).eqNullSafe(1)))).alias("no_graph"),
    )


def compute_similarity(files: DataFrame, stopwords: DataFrame) -> DataFrame:
    """S of presorted files, the diagonal included, as a table of pairs."""
    return bm25.pair_similarity(cut(bm25.bm25_weights(cut(bm25.counts(files, stopwords)))))


def postings(weights: DataFrame) -> DataFrame:
    """(repo_id, to, weights): for each term its documents and their weights in them; S in sparse form."""
    rows = weights.groupBy("repo_id", "term").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("w").cast("double").alias("w")))).alias("p"))
    return rows.select("repo_id", F.col("p.idx").alias("to"), F.col("p.w").alias("weights"))


def analyzed(files: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Presorted files of repositories that content analysis takes, as postings."""
    return postings(bm25.bm25_weights(cut(bm25.counts(files, stopwords))))


class Ordering:
    """The steps of :func:`order_files`, each a table of its own.

    ``keys`` has one row per file without its content; whatever is grouped by repository is made
    of keys, terms or edges. Contents are joined to keys by row, for analysis and for the result.
    """

    def __init__(self, files: DataFrame, stopwords: DataFrame | None = None, connection_boost: float = 1.0, max_repo_size: int = MAX_REPO_SIZE, edges: DataFrame | None = None, null_as_empty: bool = False):
        files = flat(files)
        self.boost, self.given = connection_boost, edges
        self.base = [c for c in ("file_id", "repo_id", "path", "language", "content") if c in files.columns]
        self.extras = [c for c in files.columns if c not in (*self.base, *TAKEN)]
        self.stopwords = stopwords if stopwords is not None else shipped(files.sparkSession)
        if null_as_empty:
            files = files.withColumn("content", F.coalesce("content", F.lit("")))
        self.files, self.by = keyed(files.select(*self.base, *([F.struct(*self.extras).alias("extras_")] if self.extras else [])))
        more = [c for c in self.by if c not in ("repo_id", "path")]
        keys = positions(self.files.select("repo_id", "path", *more, "language", F.col("content").isNull().alias("null_")), ["repo_id"], ["path", *more])
        keys = cut(gated(keys, max_repo_size))
        self.conditions = cut(conditions(keys))
        self.keys = keys.drop("language", "null_")
        self._order: DataFrame | None = None
        self._connections: DataFrame | None = None

    def some(self, condition: str) -> DataFrame:
        """Keys of the repositories that meet a condition."""
        return self.keys.join(self.conditions.where(condition).select("repo_id"), "repo_id", "left_semi")

    def texts(self, condition: str) -> DataFrame:
        """Presorted files, contents included, of these repositories."""
        return with_keys(self.files.select("repo_id", "path", *[c for c in self.by if c not in ("repo_id", "path")], "language", "content"), self.some(condition), self.by)

    def connections(self) -> DataFrame:
        """edges(repo_id, from_file, to_file, weight, language) of the repositories that import analysis takes."""
        if self._connections is None:
            where = "gate and not no_graph"
            if self.given is None:
                self._connections = cut(imports.import_edges(self.texts(where)))
            else:
                self._connections = self.given.join(self.conditions.where(where).select("repo_id"), "repo_id", "left_semi")
        return self._connections

    def order(self) -> DataFrame:
        """(repo_id, pos, idx, solved, has_s, matching_score) of every file."""
        if self._order is None:
            none = lambda kind: F.lit(None).cast(kind)
            terms = analyzed(self.texts("gate and n_files > 2 and not no_content"), self.stopwords)
            hubs = imports.hubs(self.connections(), self.some("gate and not no_graph"))
            size = self.conditions.where("gate").select("repo_id", F.col("n_files").alias("n"), none("int").alias("at"), *[none(k).alias(c) for c, k in (("to", "array<int>"), ("weights", "array<double>"), ("back", "array<double>"))])
            rows = size.unionByName(terms.select("repo_id", none("int").alias("n"), none("int").alias("at"), "to", "weights", none("array<double>").alias("back")))
            rows = rows.unionByName(hubs.select("repo_id", none("int").alias("n"), "at", "to", "weights", "back"))
            solved = cut(rows.groupBy("repo_id").applyInArrow(orderer(self.boost), ORDER))
            # neither terms nor an import analysis: path order
            graph = self.conditions.where("gate and not no_graph").select("repo_id", F.lit(True).alias("graph"))
            done = solved.join(graph, "repo_id", "left").where("has_s or graph").drop("graph")
            rest = self.keys.join(done.select("repo_id").distinct(), "repo_id", "left_anti")
            rest = rest.select("repo_id", F.col("idx").alias("pos"), "idx", F.lit(False).alias("solved"), F.lit(False).alias("has_s"), F.lit(None).cast("double").alias("matching_score"))
            self._order = cut(done.unionByName(rest))
        return self._order

    def result(self) -> DataFrame:
        """ordered(repo_id, pos, idx, path, language, ..., matching_score, status)."""
        status = (
            F.when(~F.col("gate"), "lexicographic_size").when(~F.col("solved"), "lexicographic_error").when(F.col("n_files") == 2, "pair")
            .when(~F.col("has_s"), "ordered_static_only").when(F.col("no_graph"), "ordered_content_only").otherwise("ordered")
        )
        placed = self.keys.join(self.order(), ["repo_id", "idx"]).join(self.conditions.select("repo_id", "no_graph"), "repo_id").withColumn("status", status)
        keep = F.col("status").isin("ordered", "ordered_content_only")
        placed = placed.select(*self.by, *[c for c in ("repo_id", "path") if c not in self.by], "pos", "idx", F.when(keep, F.col("matching_score")).alias("matching_score"), "status")
        out = with_keys(self.files, placed, self.by)
        more = [F.col(c) for c in self.base if c == "file_id"] + [F.col(f"extras_.{c}") for c in self.extras]
        return out.select("repo_id", "pos", "idx", "path", "language", "content", *more, "matching_score", "status")

    def metrics(self) -> DataFrame:
        """(repo_id, n_files, n_connections, jaccard, recall, connection_score, coherence_score).

        A repository outside the gate has no connections.
        """
        placed = self.keys.join(self.order(), ["repo_id", "idx"]).select("repo_id", "pos", "path", "matching_score")
        return repository_metrics(placed, self.connections())

    def write(self, path: str, matching_scores: bool = True, connections: bool = False, connections_score: bool = False, format: str = "parquet") -> None:
        """The ordered files in ``path``/files and, if wanted, /connections and /metrics beside them."""
        out = {"files": self.result() if matching_scores else self.result().drop("matching_score")}
        if connections:
            out["connections"] = self.connections()
        if connections_score:
            out["metrics"] = self.metrics()
        for name, df in out.items():
            df.write.mode("errorifexists").format(format).save(f"{path}/{name}")


TAKEN = ("pos", "idx", "n_files", "gate", "matching_score", "status", "solved", "has_s", "null_", "extras_", "digest_", "again_")


def order_files(files: DataFrame, stopwords: DataFrame | None = None, connection_boost: float = 1.0, max_repo_size: int = MAX_REPO_SIZE, edges: DataFrame | None = None, null_as_empty: bool = False) -> DataFrame:
    """ordered(repo_id, pos, idx, path, language, ..., matching_score, status) of every repository.

    ``edges`` replaces the import analysis by known edges; ``null_as_empty`` takes a null content
    as an empty one instead of giving its repository up. Statuses: ordered, ordered_static_only
    (no similarity), ordered_content_only (no import analysis), pair (two files: all scores one,
    none reported), lexicographic_size, lexicographic_error. ``file_id`` must be unique where it
    is given; without it repeated rows keep their places. Columns beyond the four pass through,
    but for those named like a column of the result. :class:`Ordering` has connections and metrics too.
    """
    return Ordering(files, stopwords, connection_boost, max_repo_size, edges, null_as_empty).result()


def repository_metrics(ordered: DataFrame, edges: DataFrame) -> DataFrame:
    """Connection metrics and coherence per repository."""
    return metrics.connection_metrics(ordered, edges).join(metrics.coherence(ordered), "repo_id", "left")
