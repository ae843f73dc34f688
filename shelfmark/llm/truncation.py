"""Values that were cut off, and how often each feed cuts (problem 2).

Evidence, all of it counted over the whole table:

* a vocabulary trie: for every prefix the documents of the words below it. A final word is an
  unknown proper prefix if it is a hundred times rarer than its continuations.
* length: a feed's largest length counts as a limit if most of its longest values have it.
* shape: how the last line looks, against the last lines of values that end with a line end.
* the parser: an error where the text ends.
* marks that cutting leaves (an ellipsis, a note of what is missing, half a character).

The trie is a table of prefixes, joined by key, so it may grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import language_column, small_side
from shelfmark.llm.syntax import CHECKED, errors_of
from shelfmark.runtime import cut

# What a cut leaves at the end of a value. The first is sure, the second also ends whole prose.
NOTE = (
    r"(?:…|�+|[\[<({*#/=-]*\s*(?:\.{3}\s*)?(?:truncated|snip(?:ped)?|cut(?: here| off)?|omitted|clipped)\b[^\n]{0,60}"
    r"|[^\n]{0,20}\b\d+\s+(?:more|further|remaining)?\s*(?:lines?|bytes?|chars?|characters|rows)\b[^\n]{0,12}\b(?:not shown|left|omitted|remaining|missing|skipped|more)\b[^\n]{0,12}|[\[<*][^\n]{0,30}(?:transfer|connection|download|stream)[^\n]{0,40})\s*$"
)
DOTS = r"\.{3}\s*$"
WORD = r"([A-Z]?[a-z]+|[A-Z]+(?![a-z]))"
FINAL = r"([A-Z]?[a-z]+|[A-Z]+)$"
PROSE = ("markdown", "text")
BRACES = ("javascript", "typescript", "java", "go", "c", "c#", "json")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


def trie(words: DataFrame, shallow: int = 20) -> DataFrame:
    """(key, prefix, own, below): the count of a word itself and of the longer words of its key
    below it, for prefixes of up to ``shallow`` characters of words(key, word, n)."""
    prefixes = words.where(F.length("word") > 1).select("key", "word", "n", F.explode(F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(shallow)))).alias("k"))
    below = prefixes.groupBy("key", F.expr("left(word, k)").alias("prefix")).agg(F.sum("n").alias("below"))
    own = words.groupBy("key", F.col("word").alias("prefix")).agg(F.sum("n").alias("own"))
    return below.join(own, ["key", "prefix"], "left").select("key", "prefix", F.coalesce("own", F.lit(0)).alias("own"), "below")


def continued(asked: DataFrame, words: DataFrame, shallow: int = 20) -> DataFrame:
    """(key, word, own, below) of asked(key, word) that longer words of words(key, word, n) go on from.

    Short ones are looked up in the trie. Those longer than its depth meet the words that share
    their first ``shallow`` characters, so that no word of any length is left out and none
    makes more than ``shallow`` rows.
    """
    asked = asked.select("key", "word").distinct()
    short = asked.where(F.length("word") <= shallow).join(trie(words, shallow).withColumnRenamed("prefix", "word"), ["key", "word"])
    head = lambda c: F.left(c, F.lit(shallow))
    deep = asked.where(F.length("word") > shallow).select("key", head("word").alias("head"), "word")
    others = words.where(F.length("word") > shallow).select("key", head("word").alias("head"), F.col("word").alias("other"), "n")
    met = deep.join(others, ["key", "head"]).where(F.col("other").startswith(F.col("word"))).groupBy("key", "word").agg(
        F.coalesce(F.sum(F.when(F.col("other") == F.col("word"), F.col("n"))), F.lit(0)).alias("own"), F.sum(F.when(F.col("other") != F.col("word"), F.col("n"))).alias("below")
    )
    return short.select("key", "word", "own", "below").union(met.where("below is not null").select("key", "word", "own", "below"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n): lower-case words of a text column and the number of values that have them."""
    one = texts.where("text is not null").select(F.explode(F.array_distinct(F.transform(_words(F.col("text")), F.lower))).alias("word"))
    return one.groupBy("word").agg(F.count("*").alias("n"))


def limits(lengths: DataFrame) -> DataFrame:
    """(source, cap): lengths at which a feed cuts. Just there (or up to three bytes below, for
    half a character) lie at least five different values, half of those within a tenth below,
    and more than twice as many as lie beyond. Copies count once (by a sketch of their hashes)."""
    by = lengths.groupBy("source", "len").agg(F.approx_count_distinct("hash").alias("n")).where("len >= 16").withColumn("log", (F.log("len") * 1000).cast("int"))
    w = Window.partitionBy("source")
    by = by.withColumn("at", F.sum("n").over(w.orderBy("len").rangeBetween(-3, 0))).withColumn("near", F.sum("n").over(w.orderBy("log").rangeBetween(-105, 0)))
    by = by.withColumn("beyond", F.sum("n").over(w.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)))
    found = by.where("at >= 5 and at >= 0.5 * near and at > 2 * coalesce(beyond, 0)")
    return found.groupBy("source").agg(F.max_by("len", F.struct("n", "len")).alias("cap"))


def _shape(tail: Column) -> Column:
    """The last line with words, numbers and strings made alike."""
    line = F.trim(F.substring_index(F.regexp_replace(tail, r"\s+$", ""), "\n", -1))
    s = F.regexp_replace(line, r"\"[^\"]*\"|'[^']*'", "s")
    s = F.regexp_replace(s, r"[\p{L}_][\p{L}\p{N}_]*", "w")
    s = F.regexp_replace(s, r"\d+", "0")
    s = F.regexp_replace(s, r"w(?:,? w)+", "w+")
    # of a line longer than the tail only its end can tell anything
    return F.when(tail.contains("\n"), F.right(s, F.lit(40))).otherwise(F.concat(F.lit("~"), F.right(line, F.lit(1))))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file_id, and whether the parser meets an error where the text ends."""
    for batch in batches:
        ids, langs, texts = (batch.column(k).to_pylist() for k in range(3))
        out = []
        for x, t in zip(langs, texts):
            found = errors_of(x, t) or []
            last = t.rstrip().count("\n") + 1
            sentence = t.rstrip().endswith((".", "!", "?")) and not t.rstrip().endswith("...")
            out.append(bool(found) and (any("unexpected end" in why for _, why in found) or not sentence and (found[0][0] >= last - 1 or found[-1][0] >= last)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_())], names=["file_id", "broken"])


class Truncation:
    """Cut values of ``content`` and ``path`` in a table of files.

    Null or blank values are no case; a null source has limits of its own; repeated rows are
    each judged. Columns other than file_id, path, content, language and source are ignored.
    """

    def __init__(self, files: DataFrame, rarer: float = 0.01, usual: float = 0.003):
        self.rarer, self.usual = rarer, usual
        self.files = files.select("file_id", "path", "content", F.coalesce("source", F.lit("")).alias("source"), language_column().alias("lang"), F.col("language").isNotNull().alias("told"))
        self._rows: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """What is looked at of each value, without the value: one reading of the table serves all counts."""
        if self._rows is None:
            tail, end = F.right("content", F.lit(400)), F.right("content", F.lit(120))
            rows = self.files.select(
                "file_id", "source", "lang", "told", F.col("content").rlike(r"\S").alias("whole"), F.length("content").alias("chars"), F.octet_length("content").alias("bytes"), F.xxhash64("content").alias("hash"),
                F.when(F.col("path").rlike(r"\S"), F.substring_index("path", "/", -1)).alias("base"),
                end.rlike(r"\n[ \t\r]*$").alias("ended"), end.rlike(NOTE).alias("noted"), end.rlike(DOTS).alias("dotted"),
                F.concat(F.left(tail, F.length(tail) - 120), F.regexp_replace(F.regexp_replace(end, NOTE, ""), DOTS, "")).alias("tail"),
            )
            rows = rows.select("*", _shape(F.col("tail")).alias("shape"), F.lower(F.regexp_extract("tail", FINAL, 1)).alias("final"))
            rows = rows.withColumn("open_words", F.size(_words(F.regexp_replace("tail", r"(?s)^.*(?:[.!?`]|\n\s*\n)", "")))).withColumn("stopped", F.col("dotted") | F.col("tail").rlike(r"[.!?:;)\]}>`\"'*_|=-]\s*$")).drop("tail")
            self._rows = cut(rows)
        return self._rows

    def half_words(self, finals: DataFrame) -> DataFrame:
        """(final, own, below) of final words that longer words go on from."""
        words = cut(vocabulary(self.files.select(F.col("content").alias("text"))).withColumn("key", F.lit("")))
        asked = finals.where("final <> ''").select(F.lit("").alias("key"), F.col("final").alias("word"))
        return continued(asked, words).select(F.col("word").alias("final"), "own", "below")

    def content_evidence(self) -> DataFrame:
        """One row for each value with any sign of a cut: its evidence and a score."""
        rows = self.rows.where("whole").drop("whole", "told", "base")
        chars = limits(rows.select("source", F.col("chars").alias("len"), "hash")).withColumnRenamed("cap", "cap_chars")
        bytes_ = limits(rows.select("source", F.col("bytes").alias("len"), "hash")).withColumnRenamed("cap", "cap_bytes")
        rows = rows.join(small_side(chars), "source", "left").join(small_side(bytes_), "source", "left")
        at_cap = F.coalesce(F.col("chars") == F.col("cap_chars"), F.lit(False)) | F.coalesce(F.col("bytes").between(F.col("cap_bytes") - 3, F.col("cap_bytes")), F.lit(False))
        rows = rows.withColumn("at_cap", at_cap)
        complete = rows.where("ended and not noted")
        shapes = complete.groupBy("lang", "shape").agg(F.count("*").alias("n_shape"))
        langs = complete.groupBy("lang").agg(F.count("*").alias("n_lang"))
        shapes = shapes.join(langs, "lang").where((F.col("n_shape") >= 2) & (F.col("n_shape") >= self.usual * F.col("n_lang"))).select("lang", "shape", F.lit(True).alias("known"))
        some = cut(rows.where("not ended or at_cap or noted").join(shapes, ["lang", "shape"], "left"))
        some = some.join(self.half_words(some), "final", "left")
        some = some.withColumn("half_word", F.coalesce((F.col("final") != "") & (F.col("own") < self.rarer * F.col("below")), F.lit(False)))
        code = some.where(F.col("lang").isin(*CHECKED)).select("file_id")
        texts = self.files.where(F.col("lang").isin(*CHECKED)).join(code, "file_id", "left_semi").select("file_id", "lang", "content")
        some = some.join(texts.mapInArrow(_parse, "file_id long, broken boolean"), "file_id", "left")
        prose, broken = F.col("lang").isin(*PROSE), F.coalesce(F.col("broken"), F.lit(False))
        # prose: a sentence of four words or more that just stops; elsewhere: a last line as no whole
        # value has, which in languages of braces tells nothing if every brace is closed
        strange = F.when(prose, ~F.col("stopped") & (F.col("open_words") >= 4) & F.col("known").isNull()).otherwise(F.col("known").isNull() & (broken | ~F.col("lang").isin(*BRACES)))
        score = (
            F.when(F.col("ended"), 0).otherwise(1)
            + 2 * F.col("half_word").cast("int") + 2 * strange.cast("int") + 2 * F.col("at_cap").cast("int")
            + 2 * broken.cast("int") + 3 * F.col("noted").cast("int") + F.when(F.col("dotted") & ~prose, 1).otherwise(0)
        )
        # a line end speaks for a whole value, unless the limit or a note speaks against it
        return some.select("file_id", "source", "lang", "ended", "noted", "dotted", "at_cap", "half_word", strange.alias("strange"), broken.alias("broken"), score.alias("score"))

    def path_evidence(self) -> DataFrame:
        """One row for each cut path: the rule that told it."""
        rows = self.rows.where("base is not null").select("file_id", "source", "lang", "told", "base")
        rows = rows.select("*", F.lower(F.regexp_extract("base", r"\.([A-Za-z0-9]*)$", 1)).alias("ext"), F.col("base").contains(".").alias("has_dot"))
        # endings: in their language where it is told, else among all
        told = F.when(F.col("told"), F.col("lang")).otherwise(F.lit("*"))
        ends = cut(rows.where("ext <> ''").groupBy("lang", "told", "ext").agg(F.count("*").alias("n")))
        counted = ends.where("told").select(F.col("lang").alias("key"), F.col("ext").alias("word"), "n").union(ends.groupBy(F.lit("*"), "ext").agg(F.sum("n")))
        half = continued(counted, counted).where(F.col("own") < 3 * self.rarer * F.col("below")).select("key", F.col("word").alias("ext"), F.lit(True).alias("half_end"))
        # names without an ending, against all names that go on from them
        names = cut(rows.groupBy(F.lit("").alias("key"), F.col("base").alias("word"), "has_dot").agg(F.count("*").alias("n")))
        bare = names.where(~F.col("has_dot")).select("key", "word", F.col("n").alias("n_base"))
        bare = bare.join(continued(bare, names.select("key", "word", "n")), ["key", "word"], "left").withColumnRenamed("word", "base").withColumn("goes_on", F.coalesce("below", F.lit(0)))
        whole = ((F.col("n_base") >= 2) & (F.col("n_base") >= F.col("goes_on"))) | F.col("base").rlike(r"^[A-Z][A-Z_]{2,}$|^[A-Z][a-z]+file$|^\.[a-z]+")
        bare = bare.select("base", whole.alias("whole_name"))
        joined = rows.withColumn("key", told).join(half, ["key", "ext"], "left").join(bare, "base", "left")
        why = (
            F.when(F.col("base").rlike(r"(?:\.{2,}|…|�)$"), "mark").when((F.col("base").rlike("~$")) & ~F.col("base").rlike(r"\.[A-Za-z]{1,5}~$"), "mark")
            .when(F.col("base") == "", "folder").when(F.col("base").rlike(r"\.$"), "ending").when(F.col("half_end"), "ending")
            .when(~F.col("has_dot") & ~F.col("whole_name"), "name")
        )
        return joined.select("file_id", "source", why.alias("why")).where("why is not null")

    def found(self) -> DataFrame:
        """(file_id, field): the cut values."""
        content = self.content_evidence().where("score >= 3").select("file_id", F.lit("content").alias("field"))
        return content.union(self.path_evidence().select("file_id", F.lit("path").alias("field"))).distinct()

    def rates(self) -> DataFrame:
        """(source, rows, cut_contents, cut_paths, share): how often each feed cuts."""
        f = self.found().groupBy("file_id").agg(F.max((F.col("field") == "content").cast("int")).alias("c"), F.max((F.col("field") == "path").cast("int")).alias("p"))
        j = self.rows.select("file_id", "source").join(f, "file_id", "left")
        return j.groupBy("source").agg(
            F.count("*").alias("rows"), F.sum(F.coalesce("c", F.lit(0))).alias("cut_contents"), F.sum(F.coalesce("p", F.lit(0))).alias("cut_paths"),
            F.round(F.avg(F.coalesce(F.greatest("c", "p"), F.lit(0)).cast("double")), 6).alias("share"),
        )
