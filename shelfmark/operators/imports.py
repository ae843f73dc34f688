"""Python imports: extraction, resolution to files, propagation of names, edges.

Only reading the syntax needs Python workers (one Arrow pass over Python files); resolution,
propagation and edges are joins keyed by repository.
"""

from __future__ import annotations

import ast
import posixpath
import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import normal_path, word_tokens
from shelfmark.runtime import cut

IMPORTS = "repo_id string, path string, pos int, module string, level int, name string"


def names_in(source: str) -> list[tuple[str, int, str]]:
    """(module, level, name) of the import statements, grouped by first appearance of their module.

    A text that does not parse is tried again with the lines that hold ``import `` only.
    """
    found: dict[tuple[str, int], list[str]] = {}

    def collect(text: str) -> None:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        todo: list[ast.AST] = [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, ast.Import):
                for a in node.names:
                    found.setdefault((a.name, 0), []).append(a.name)
            elif isinstance(node, ast.ImportFrom):
                found.setdefault((node.module or "", node.level), []).extend(a.name for a in node.names)
            else:
                todo.extend(reversed(list(ast.iter_child_nodes(node))))

    for text in (source, "\n".join(x.lstrip() for x in source.split("\n") if "import " in x)):
        try:
            collect(text)
            break
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            found.clear()
    return [(m, level, n) for (m, level), ns in found.items() for n in ns]


def candidates(module: str, level: int, path: str) -> list[str]:
    """Files a module may mean, best first: beside the importer, then from the root."""
    here = posixpath.dirname(path)
    for _ in range(max(level - 1, 0)):
        here = posixpath.dirname(here)
    rest = module.replace(".", "/")
    out = []
    for base in (here, "/"):
        p = posixpath.normpath(posixpath.join(base, rest)) if rest else posixpath.normpath(base)
        p = "/" + p.lstrip("/")
        out += [p + ".py" if p != "/" else "/.py", posixpath.join(p, "__init__.py")]
    return out


# Language -> (import statements of a text, files that one may mean); see :func:`register`.
Extract = Callable[[str], list[tuple[str, int, str]]]
Candidates = Callable[[str, int, str], list[str]]
ANALYZERS: dict[str, tuple[Extract, Candidates]] = {"Python": (names_in, candidates)}


def register(language: str, extract: Extract, find: Candidates) -> None:
    """An import analysis of one's own: ``extract`` as :func:`names_in`, ``find`` as :func:`candidates`."""
    ANALYZERS[language] = (extract, find)


def _extractor(extract: Extract, find: Candidates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if text is not None:
                    rows.extend((repo, path, k, *x, find(x[0], x[1], path)) for k, x in enumerate(extract(text)))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["repo_id", "path", "pos", "module", "level", "name", "candidates"])

    return run


def source_files(files: DataFrame, language: str = "Python") -> DataFrame:
    """(repo_id, path, content) of a language's files; of repeated paths the last row counts.

    Which row that is comes from the keys alone; contents are only joined to it.
    """
    f = files.where(F.col("language") == language).withColumn("path", normal_path())
    if "idx" not in f.columns:
        return f.groupBy("repo_id", "path").agg(F.max_by("content", F.coalesce("content", F.lit(""))).alias("content"))
    last = f.groupBy("repo_id", "path").agg(F.max("idx").alias("idx"))
    return f.join(last, ["repo_id", "path", "idx"], "left_semi").select("repo_id", "path", "content")


def extracted(files: DataFrame, language: str = "Python") -> DataFrame:
    """(repo_id, path, pos, module, level, name, candidates) of a language's files."""
    return source_files(files, language).mapInArrow(_extractor(*ANALYZERS[language]), IMPORTS + ", candidates array<string>")


def import_rows(files: DataFrame, language: str = "Python") -> DataFrame:
    """imports(repo_id, seq, name, module, from_file, to_file): names whose module is a file here."""
    return resolved(extracted(files, language), files, language)


def with_candidates(facts: DataFrame) -> DataFrame:
    """Import facts (path, module, level, ...) with the files each may mean, as an expression.

    Best first: beside the importer (``level - 1`` steps up), then from the root; ``P.py`` before
    ``P/__init__.py``. Module paths are folded lexically.
    """
    parts = F.split("path", "/")
    here = F.slice(parts, 1, F.greatest(F.lit(1), F.size(parts) - 1 - F.greatest(F.col("level") - 1, F.lit(0))))
    rest = F.split(F.replace("module", F.lit("."), F.lit("/")), "/")
    bases = F.array(F.array_join(F.filter(F.concat(here, rest), lambda x: x != ""), "/"), F.array_join(F.filter(rest, lambda x: x != ""), "/"))
    files = F.flatten(F.transform(bases, lambda p: F.array(F.concat(F.lit("/"), p, F.lit(".py")), F.concat(F.lit("/"), p, F.when(p == "", "").otherwise("/"), F.lit("__init__.py")))))
    return facts.withColumn("candidates", files)


def resolved(found: DataFrame, files: DataFrame, language: str = "Python") -> DataFrame:
    """Import rows of facts (repo_id, path, pos, module, level, name, candidates) whose module is a file here."""
    tried = found.select("repo_id", F.col("path").alias("to_file"), "pos", "module", "level", "name", F.posexplode("candidates").alias("prio", "path"))
    known = files.where(F.col("language") == language).select("repo_id", normal_path().alias("path")).distinct()
    hit = tried.join(known, ["repo_id", "path"]).groupBy("repo_id", "to_file", "pos", "module", "name").agg(F.min_by("path", "prio").alias("from_file"))
    seq = F.row_number().over(Window.partitionBy("repo_id").orderBy("to_file", "pos")).cast("long")
    return hit.select("repo_id", seq.alias("seq"), "name", "module", "from_file", "to_file")


def tokens(files: DataFrame) -> DataFrame:
    """(repo_id, from_file, words): distinct word tokens of files."""
    return files.select("repo_id", F.col("path").alias("from_file"), word_tokens(F.col("content")).alias("words"))


def one_round(imports: DataFrame) -> DataFrame:
    """Names seen through the defining file's own imports, or through its star imports.

    The last row of a (name, file) wins. Not filtered by what the files hold; see :func:`propagated`.
    """
    own = imports.groupBy("repo_id", "name", F.col("to_file").alias("from_file")).agg(F.max_by("from_file", "seq").alias("deeper"))
    star = own.where("name = '*'").select("repo_id", "from_file", F.col("deeper").alias("through_star"))
    j = imports.join(own, ["repo_id", "name", "from_file"], "left").join(star, ["repo_id", "from_file"], "left")
    deeper = F.coalesce("deeper", "through_star")
    return j.select("repo_id", "seq", "name", "module", deeper.alias("from_file"), "to_file").where(F.col("from_file").isNotNull() & (F.col("from_file") != F.col("to_file")))


def merged(imports: DataFrame) -> DataFrame:
    """One row per (name, from, to): the one of the largest seq, which is the one that counts."""
    key = ["repo_id", "name", "from_file", "to_file"]
    return imports.groupBy(*key).agg(F.max("seq").alias("seq"), F.max_by("module", "seq").alias("module")).select("repo_id", "seq", "name", "module", "from_file", "to_file")


def propagated(imports: DataFrame, files: DataFrame, rounds: int = 3, language: str = "Python") -> DataFrame:
    """imports and what three rounds of looking through add; a name must occur in its new file."""
    wanted = imports.select("repo_id", F.col("from_file").alias("path")).distinct()
    held = cut(tokens(source_files(files, language).join(wanted, ["repo_id", "path"], "left_semi")))
    now = imports
    for _ in range(rounds):
        more = one_round(now).join(held, ["repo_id", "from_file"]).where(F.array_contains("words", F.col("name"))).drop("words")
        top = now.groupBy("repo_id").agg(F.max("seq").alias("top"))
        more = more.join(top, "repo_id").withColumn("seq", F.col("top") + F.col("seq")).select(*imports.columns)
        now = cut(merged(now.select(*imports.columns).unionByName(more)))
    return now


def edges_of(imports: DataFrame, language: str = "Python") -> DataFrame:
    """edges(repo_id, from_file, to_file, weight, language): from the definition to the importer."""
    return imports.select("repo_id", "from_file", "to_file").distinct().select("*", F.lit(1.0).alias("weight"), F.lit(language).alias("language"))


def import_edges(files: DataFrame) -> DataFrame:
    """Edges of every language that has an import analysis."""
    parts = [edges_of(propagated(cut(import_rows(files, x)), files, language=x), x) for x in ANALYZERS]
    return reduce(DataFrame.unionByName, parts)


def backward(edges: DataFrame, decay: float = 0.25) -> DataFrame:
    """Python edges turned round."""
    return edges.where("language = 'Python'").select("repo_id", F.col("to_file").alias("from_file"), F.col("from_file").alias("to_file"), (F.col("weight") * decay).alias("weight"), "language")


def without_self(edges: DataFrame) -> DataFrame:
    return edges.where("from_file <> to_file")


def siblings(edges: DataFrame, weight: float = 0.5) -> DataFrame:
    """Files that import from one file, in both directions; edges to a file itself do not count.

    Pairs of edges, not of files: repeated edges make repeated pairs. Unlike edges of one file
    are paired by position, so an edge never meets itself.
    """
    e = without_self(edges)
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("repo_id", "from_file").orderBy("to_file", "weight")))
    a, b = e.alias("a"), e.alias("b")
    pair = a.join(b, (F.col("a.repo_id") == F.col("b.repo_id")) & (F.col("a.from_file") == F.col("b.from_file")) & (F.col("a.k") != F.col("b.k")))
    return pair.select(F.col("a.repo_id"), F.col("a.to_file").alias("from_file"), F.col("b.to_file").alias("to_file"), F.lit(weight).alias("weight"), F.col("a.language"))


def summed(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo_id", "from_file", "to_file").agg(F.sum("weight").alias("weight"), F.first("language").alias("language"))


def augmented(edges: DataFrame) -> DataFrame:
    return summed(edges.unionByName(backward(edges)).unionByName(siblings(edges)))


def indexed(edges: DataFrame, files: DataFrame) -> DataFrame:
    """graph(repo_id, i, j, g): edges by position; of repeated paths the first counts."""
    at = files.groupBy("repo_id", "path").agg(F.min("idx").alias("k"))
    i = at.select("repo_id", F.col("path").alias("from_file"), F.col("k").alias("i"))
    j = at.select("repo_id", F.col("path").alias("to_file"), F.col("k").alias("j"))
    return edges.join(i, ["repo_id", "from_file"]).join(j, ["repo_id", "to_file"]).groupBy("repo_id", "i", "j").agg(F.sum("weight").alias("g"))


def name_occurs(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Import rows whose name is a word of the file that defines it."""
    held = tokens(files).select("repo_id", "from_file", F.explode("words").alias("name")).distinct()
    return imports.join(held, ["repo_id", "from_file", "name"], "left_semi")


def hubs(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, at, to, weights, back): one row for each file that others import, by position.

    ``at`` is the file's own position (null if it is none of ``files``), ``to`` those of its
    importers, ``back`` the weights that count in the other direction. From these rows a
    repository's whole graph follows, so pairs of importers need no table.
    """
    first = files.groupBy("repo_id", "path").agg(F.min("idx").alias("k"))
    j = edges.join(first.select("repo_id", F.col("path").alias("to_file"), F.col("k").alias("j")), ["repo_id", "to_file"])
    own = F.struct("j", "weight", F.when(F.col("language") == "Python", F.col("weight")).otherwise(0.0).alias("back"))
    rows = j.groupBy("repo_id", "from_file").agg(F.array_sort(F.collect_list(own)).alias("e"))
    at = first.select("repo_id", F.col("path").alias("from_file"), F.col("k").alias("at"))
    return rows.join(at, ["repo_id", "from_file"], "left").select("repo_id", "at", *[F.col(f"e.{c}").alias(n) for c, n in (("j", "to"), ("weight", "weights"), ("back", "back"))])
