"""Which files were not written by hand for their repository (problem 5).

Every file gives evidence for five labels (handwritten, generated, minified, vendored, blob)
as log potentials from its own text and name. Whether plain source was written here or taken over
its text does not tell; that comes from where it lies. The directories of a repository form a
tree, in which folders and files that lie in one another tend to share their label; a folder set
apart by its name (the library below ``node_modules`` and the like) has evidence of its own and
says nothing about the folder around it. Belief propagation over the tree is exact: one pass up
and one pass down, level by level. The messages of a directory's files are added up before
anything is joined, so a directory of any size is one aggregate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import let
from shelfmark.llm.common import language_column
from shelfmark.llm.docpairs import PARTS
from shelfmark.runtime import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
CODE = ("python", "javascript", "typescript", "java", "go", "c", "c#", "ruby", "json", "c++", "php", "rust", "")

# Compatibilities of a label with itself, between a file and its folder, and between folders.
FILE_TIES = (1.0, 1.0, 1.0, 1.0, 1.0)
FOLDER_TIES = (4.0, 1.0, 1.0, 4.0, 1.0)
# Log potentials: the root is its repository's own; a library's folder is vendored.
ROOT, LIBRARY, LIKELY_LIBRARY = 6.0, 6.0, 5.0

# What tools and people call such files and folders.
LIBRARIES = ("third_party", "third-party", "thirdparty", "node_modules", "_vendored", "vendored", "bower_components", "external", "externals", "deps", "bundled")
WEAK_VENDOR = ("vendor", "vendors")
GENERATED_DIRS = re.compile(r"(?:^|/)(?:gen|generated|autogen|auto[_-]generated|generated[_-]sources|__generated__)/", re.IGNORECASE)
GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:-c)?\.(?:go|c|h|cc|rb|js|ts)|\.g\.cs|\.g\.dart|\.designer\.cs|\.generated\.\w+|_gen(?:erated)?\.\w+|_Gen\.java|Grpc\.java|[._]tab\.[ch]|lex\.yy\.c|_string\.go|\.pb\.\w+)(?:$|[ (_.-])", re.IGNORECASE)
MINIFIED_NAME = re.compile(r"(?:[.-]min|\.bundle|\.chunk|-[0-9a-f]{8,})\.(?:js|mjs|css)$")
BUILT_DIRS = re.compile(r"(?:^|/)(?:dist|static/js|public/assets|build/static)/")
LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|composer\.lock(?:\.json)?|deps\.lock(?:\.json)?|[\w.-]*[._-]lock\.(?:json|ya?ml)|yarn\.lock|poetry\.lock|pipfile\.lock|cargo\.lock|gemfile\.lock|go\.sum|pnpm-lock\.yaml)$", re.IGNORECASE)
MAP_NAME = re.compile(r"\.map(?:\.json)?$|\.js\.map$")
DATA_NAME = re.compile(r"(?:_|\b)(?:fixtures?|dump|export|records|snapshot|data|blob|table)\.(?:json|py|js|ts|rb|go|c|java|cs)$", re.IGNORECASE)
COMMENT = r"(?:^|\n)[ \t]*(?://+|#+|/?\*+!?|--|;|<!--|\"\"\"|''')[^\n]{0,40}"
ORIGIN = re.compile(
    COMMENT + r"(?:code generated by\b|<auto-?generated|@generated\b|auto-?generated (?:file|code|by|from)\b|(?:file|code|module|class|source)?\s*(?:was |is )?(?:automatically|auto|machine)[ -]generated\b"
    r"|source: \S+\.(?:proto|thrift|idl|schema|g4|avsc|fbs|y|l)\b|(?:written|made|emitted|produced|output) by \S*(?:protoc|codegen|-gen\b|gen-)\S*|generated (?:automatically |by |from |with |using )(?:\S+ )*?[\w.-]*\d|(?:created|produced|emitted|built|written|output) by (?:the )?[\w .-]{2,60}(?:compiler|generator|codegen|tool|bison|flex|protoc|thrift)[\w .,-]{0,40}(?:do not|don't|never)|do not (?:edit|modify|change)[ ,.:;-]*(?:by hand|manually|this file)?\s*(?:\n|$|\*))",
    re.IGNORECASE,
)
UPSTREAM = re.compile(COMMENT + r"(?:upstream copy|vendored (?:copy|from)|bundled from|copied from upstream|third[- ]party (?:copy|code|library)|imported from upstream|taken from https?://)", re.IGNORECASE)
OWNERS = re.compile(r"\(c\)[^\n]{0,60}\b(?:contributors|authors|maintainers)\b", re.IGNORECASE)
BANNER = re.compile(r"^\s*/\*!\s*\S+ v?\d+(?:\.\d+)+")
NUMBERED = re.compile(r"[A-Za-z_](\d{1,4})\s?(?:\(|=\s?(?:async\s)?(?:function\b|\())")
PEM = re.compile(r"-----BEGIN [^-]+-----[\s\S]*?(?:-----END [^-]+-----|\Z)")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{200,}={0,2}")
NUMBERS = re.compile(r"(?:(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[\s,;]+){12,}")
TUPLE = re.compile(r"(?m)^[ \t]*[\[({][^\n]{8,400}[\])}],?[ \t]*$")
SHAPE = re.compile(r"[A-Za-z0-9_.+-]+")


def noted(pattern: re.Pattern, text: str, language: str) -> bool:
    """Whether a notice stands anywhere in ``text``, but not inside a string that holds the text of another file."""
    parts, at = PARTS.get(language), 0
    inside = None
    while m := pattern.search(text, at):
        if parts is None:
            return True
        if inside is None:
            inside = [x.span() for x in parts.finditer(text) if x.group(1) is None]
        mark = m.start() + len(m.group()) - len(m.group().lstrip())
        if not any(a < mark < b for a, b in inside):
            return True
        at = m.end()
    return False


def evidence(path: str, language: str, text: str | None) -> tuple[float, float, float, float, float]:
    """Log potentials of the five labels for one file, from its text and name; all the text is read.

    Plain source is as likely vendored as handwritten.
    """
    hand, gen, mini, vend, blob = 2.0, 0.0, 0.0, 0.0 if language == "json" else 2.0, 0.0
    name = path.rsplit("/", 1)[-1]
    lock = bool(LOCK_NAME.search(path))
    if text is None or not text.strip():
        return (9.0, 0.0, 0.0, 0.0, 0.0)
    if language not in CODE and not lock:
        return (9.0, 0.0, 0.0, 0.0, 0.0)
    text = text.removeprefix("﻿")
    size = len(text)
    if lock and ("ersion" in text or "integrity" in text or "checksum" in text):
        gen += 6
    if '"mappings"' in text and ('"sources"' in text or '"names"' in text) or MAP_NAME.search(name) and '"version"' in text:
        gen += 7
    if language == "json" and not lock and gen == 0:
        # exported records: many lines of one shape, or a long list of them
        rows = TUPLE.findall(text)
        if len(rows) >= 8:
            shapes = {SHAPE.sub("w", r.strip().rstrip(",")) for r in rows}
            if len(shapes) <= max(3, 0.2 * len(rows)) and sum(map(len, rows)) > 0.6 * size:
                blob += 6
        if text.lstrip()[:1] == "[" and text.count("{") >= 20 and text.count('"id"') >= 8:
            blob += 2
        if text.count('"integrity"') >= 3 and text.count('"resolved"') >= 3:
            gen += 6
    top = path.split("/", 2)[1] if path.count("/") > 1 else ""
    if top and language == "python" and re.search(rf"^[ \t]*(?:from|import)[ \t]+{re.escape(top)}\.", text, re.MULTILINE):
        hand += 1.5  # it uses the repository's own modules
    if noted(ORIGIN, text, language):
        gen += 6
    if GENERATED_NAME.search(name):
        gen += 2
    if GENERATED_DIRS.search(path):
        gen += 1.2
    runs = [int(n) for n in NUMBERED.findall(text)] if language != "json" else []
    if len(runs) >= 3:
        steps = sum(b == a + 1 for a, b in zip(runs, runs[1:]))
        if steps >= 0.6 * (len(runs) - 1):
            gen += 4.5 if steps >= 3 else 2.5
    if gen and 2 <= len(set(runs)) and gen < 4:
        gen += 1.5
    if noted(UPSTREAM, text, language):
        vend += 5
    if noted(OWNERS, text, language):
        vend += 2.5
    if language != "json":
        lines = text.split("\n")
        longest = max(map(len, lines))
        long = sum(len(x) for x in lines if len(x) > 250)
        space = sum(map(text.count, " \t\n")) / size
        encoded = numbers = 0
        figures = sum(map(text.count, "0123456789"))
        if longest > 190 or figures > 0.1 * size:
            bare = PEM.sub("", text) if "-----BEGIN" in text else text
            encoded = sum(len(m) for m in ENCODED.findall(bare))
            numbers = sum(len(m.group()) for m in NUMBERS.finditer(bare)) if figures > 0.1 * size else 0
            if encoded > 0.4 * size and encoded >= 250:
                blob += 6
            elif numbers > 0.5 * size and numbers >= 250:
                blob += 6
            else:
                rows = TUPLE.findall(bare)
                if len(rows) >= 8:
                    shapes = {SHAPE.sub("w", r.strip().rstrip(",")) for r in rows}
                    digits = sum(c.isdigit() for r in rows for c in r)
                    if len(shapes) <= max(3, 0.25 * len(rows)) and sum(map(len, rows)) > 0.6 * size and digits > 0.15 * size:
                        blob += 6
        if long > 0.6 * size and space < 0.16 and encoded < 0.4 * size and language in ("javascript", "typescript", ""):
            mini += 5
            if text.count(";") + text.count("}") > 0.015 * size:
                mini += 1
            if MINIFIED_NAME.search(name) or BANNER.match(text) or BUILT_DIRS.search(path):
                mini += 1.5
        elif MINIFIED_NAME.search(name):
            mini += 0.5
    if blob and DATA_NAME.search(name):
        blob += 0.5
    return (hand, gen, mini, vend, blob)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, repos, paths, langs, texts = (batch.column(k).to_pylist() for k in range(5))
        phi = [evidence(p, x, t) for p, x, t in zip(paths, langs, texts)]
        cols = [pa.array([f[k] for f in phi], pa.float64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(repos, pa.string()), pa.array([p.rsplit("/", 1)[0] for p in paths], pa.string()), *cols], names=["file_id", "repo_id", "dir", *LABELS])


def message(belief: Column, ties: tuple[float, ...]) -> Column:
    """What an array of log beliefs says to a neighbour: for each label the log of the sum over the
    own labels, those that agree weighted by their tie."""
    gain = F.array(*[F.lit(math.expm1(t)) for t in ties])
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    sent = lambda e: let(total(e), lambda t: F.zip_with(e, gain, lambda x, g: F.log1p(g * x / t)))
    scaled = lambda b: let(F.array_max(b), lambda top: F.transform(b, lambda x: F.exp(x - top)))
    return let(belief, lambda b: let(scaled(b), sent))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _sum(c: str) -> Column:
    return F.array(*[F.sum(F.col(c)[k]) for k in range(len(LABELS))])


class Provenance:
    """Labels of files (file_id, repo_id, path, content, language).

    Null or blank contents and texts or configuration are handwritten and have no say about their
    folder. A null path counts as the repository's root. Other columns are ignored.
    """

    def __init__(self, files: DataFrame, rare: float = 0.02):
        self.rare = rare
        path = F.coalesce("path", F.lit(""))
        path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
        source = files.withColumn("path", path)
        rows = source.select("file_id", F.coalesce("repo_id", F.lit("")).alias("repo_id"), "path", language_column().alias("language"), "content")
        self.evidence = cut(rows.mapInArrow(_measure, "file_id long, repo_id string, dir string, " + ", ".join(f"{x} double" for x in LABELS)))

    def folders(self) -> DataFrame:
        """(repo_id, dir, depth, apart, f): every folder with its own potentials and its files' messages.

        A folder below one called "vendor" may be about vendors: it is a library only if few
        repositories have a folder of its name.
        """
        zero = F.array(*[F.lit(0.0)] * len(LABELS))
        told = F.when(F.col("handwritten") > 8, zero).otherwise(message(F.array(*LABELS), FILE_TIES))
        base = self.evidence.select("repo_id", "dir", told.alias("s")).groupBy("repo_id", "dir").agg(_sum("s").alias("f"))
        parts = F.split("dir", "/")
        every = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir")
        dirs = cut(base.select("repo_id", every).distinct().join(base, ["repo_id", "dir"], "left"))
        name, above = F.lower(F.element_at(F.split("dir", "/"), -1)), F.lower(F.try_element_at(F.split("dir", "/"), F.lit(-2)))
        names = dirs.groupBy(name.alias("name")).agg(F.countDistinct("repo_id").alias("n"))
        repos = dirs.where("dir = ''").count()
        dirs = dirs.withColumn("name", name).join(names.select("name", (F.col("n") <= max(2, self.rare * repos)).alias("rare")), "name")
        vendored = F.when(above.isin(*LIBRARIES), LIBRARY).when(above.isin(*WEAK_VENDOR) & F.col("rare"), LIKELY_LIBRARY).otherwise(0.0)
        own = F.array(F.when(F.col("dir") == "", ROOT).otherwise(0.0), F.lit(0.0), F.lit(0.0), vendored, F.lit(0.0))
        return dirs.select("repo_id", "dir", (F.size(F.split("dir", "/")) - 1).alias("depth"), (vendored > 0).alias("apart"), _plus(own, F.coalesce("f", zero)).alias("f"))

    def beliefs(self) -> DataFrame:
        """(repo_id, dir, b): log beliefs of the folders, from all files and folders of the tree.

        Up: each level, the deepest first, adds the messages ``u`` of the level below. Down: each
        level adds what the folder above believes without it.
        """
        zero = F.array(*[F.lit(0.0)] * len(LABELS))
        dirs = cut(self.folders())
        deepest = dirs.agg(F.max("depth")).first()[0]
        if deepest is None:
            return dirs.select("repo_id", "dir", F.col("f").alias("b"))
        parent = F.regexp_replace("dir", r"/[^/]*$", "")
        levels: list[DataFrame] = []
        below = None
        for d in range(deepest, -1, -1):
            here = dirs.where(F.col("depth") == d)
            if below is not None:
                c = below.groupBy("repo_id", F.col("parent").alias("dir")).agg(_sum("u").alias("c"))
                here = here.join(c, ["repo_id", "dir"], "left").withColumn("f", _plus(F.col("f"), F.coalesce("c", zero)))
            u = F.when(F.col("apart") | (F.col("dir") == ""), zero).otherwise(message(F.col("f"), FOLDER_TIES))
            below = cut(here.select("repo_id", "dir", parent.alias("parent"), "apart", "f", u.alias("u")))
            levels.append(below)
        done = [levels.pop().select("repo_id", "dir", F.col("f").alias("b"))]
        while levels:
            above = done[-1].select("repo_id", F.col("dir").alias("parent"), F.col("b").alias("p"))
            down = F.when(F.col("apart"), zero).otherwise(message(_minus(F.col("p"), F.col("u")), FOLDER_TIES))
            done.append(cut(levels.pop().join(above, ["repo_id", "parent"]).select("repo_id", "dir", _plus(F.col("f"), down).alias("b"))))
        out = done[0]
        for x in done[1:]:
            out = out.union(x)
        return out

    def labels(self) -> DataFrame:
        """(file_id, repo_id, label, p_handwritten, own_label): the last from the file's own evidence alone."""
        own = F.array(*LABELS)
        fixed = F.col("handwritten") > 8
        told = F.when(fixed, own).otherwise(_plus(own, message(_minus(F.col("b"), message(own, FILE_TIES)), FILE_TIES)))
        j = self.evidence.join(self.beliefs(), ["repo_id", "dir"]).select("file_id", "repo_id", told.alias("x"), own.alias("own"))
        names = F.array(*[F.lit(x) for x in LABELS])
        share = let(F.col("x"), lambda x: let(F.array_max(x), lambda top: F.exp(x[0] - top) / F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))))
        best = lambda c: let(F.col(c), lambda x: names[(F.array_position(x, F.array_max(x)) - 1).cast("int")])
        return j.select("file_id", "repo_id", best("x").alias("label"), F.round(share, 6).alias("p_handwritten"), best("own").alias("own_label"))

    def foreign(self) -> DataFrame:
        """(file_id): files that were most likely not written by hand here."""
        return self.labels().where("label <> 'handwritten'").select("file_id")
