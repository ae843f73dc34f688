"""Term counts, BM25 weights and the asymmetric pair similarity, per repository.

Long tables stand for matrices: tf(repo_id, idx, term, tf), weights(repo_id, idx, term, w),
sim(repo_id, i, j, s); an absent row is 0. A file's words are counted inside its row, and its
terms are summed where the row lies, so ``content`` crosses no shuffle here; what is known of a
repository reaches the rows through its documents and its vocabulary, never by ``repo_id`` alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.functions.stopwords import by_analyzer
from shelfmark.operators import blocks
from shelfmark.runtime import cut, small


def raw_words(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(repo_id, idx, *keep, analyzer, word, n): identifiers of path and content with their counts.

    In languages where words count once, n is 1. Files with null content have no rows.
    """
    words = files.select("repo_id", "idx", *keep, X.analyzer().alias("analyzer"), F.inline(X.counted(X.identifiers(X.document_text()))).alias("word", "n"))
    return words.withColumn("n", F.when(F.col("analyzer").isin(*X.ONCE), F.lit(1).cast("long")).otherwise(F.col("n")))


def kept_words(words: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Stemmed words longer than two characters that are no stop words; the stem comes first.

    Words are not shuffled for a stop list of usual size, so a file's words stay together.
    """
    stemmed = words.withColumn("word", X.singular(F.col("word"))).where(F.length("word") > X.MIN_LENGTH)
    return stemmed.join(small(by_analyzer(stopwords)), ["analyzer", "word"], "left_anti")


def counts(files: DataFrame, stopwords: DataFrame) -> DataFrame:
    """tf(repo_id, idx, n_files, term, tf) of presorted files.

    No step crosses words, so each is analysed once per file. Rows with a file_id come from a
    join on it and are summed without a further shuffle.
    """
    return _summed(files, stopwords).drop("file_id")


def _summed(files: DataFrame, stopwords: DataFrame) -> DataFrame:
    keep = tuple(c for c in ("file_id", "n_files") if c in files.columns)
    kept = kept_words(raw_words(files, keep), stopwords)
    by = ["repo_id", "idx", *keep]
    return kept.select(*by, "n", F.inline(X.weighted_terms(F.col("word")))).groupBy(*by, "term").agg(F.sum(F.col("n") * F.col("m")).alias("tf"))


def packed(files: DataFrame, stopwords: DataFrame, split: bool = False) -> DataFrame:
    """docs(repo_id, idx, n, terms, tf) of presorted files with ``n_files``: a row for each file that has terms, packed where its terms lie.

    ``split`` gives a file of a large repository a row for each ``block`` of terms.
    """
    tf = _summed(files, stopwords)
    if split:
        tf = tf.withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("n_files") / blocks.ROWS)))
    docs = tf.groupBy(*[c for c in tf.columns if c not in ("term", "tf")]).agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tf"))
    return docs.select("repo_id", "idx", F.col("n_files").alias("n"), *["block"] * split, "terms", "tf")


def term_counts(files: DataFrame, stopwords: DataFrame) -> DataFrame:
    """tf(repo_id, idx, term, tf)."""
    return counts(files, stopwords).select("repo_id", "idx", "term", "tf")


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("repo_id", "term").agg(F.count("*").alias("df"))


def sizes(files: DataFrame) -> DataFrame:
    """(repo_id, n): files of a repository, empty ones too."""
    return files.groupBy("repo_id").agg(F.count("*").alias("n"))


def vocabulary(tf: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """(repo_id, term, df, n, total): terms in at least two and at most max(n - 1, 3) files.

    The size n of a repository comes with the rows (``n_files``) or from a table of its own.
    """
    size = [F.max("n_files").cast("long").alias("n")] if n is None else []
    terms = tf.groupBy("repo_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), *size)
    terms = terms if n is None else terms.join(n.select("repo_id", "n"), "repo_id")
    return terms.where((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.col("n") - 1, F.lit(3)))).select("repo_id", "term", "df", "n", "total")


def pruned(tf: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """tf with df and n, only terms of the vocabulary."""
    return tf.drop("n_files").join(vocabulary(tf, n).drop("total"), ["repo_id", "term"])


def mean_length(terms: DataFrame) -> DataFrame:
    """(repo_id, avg): mean length of a repository's files in terms of its vocabulary."""
    return terms.groupBy("repo_id").agg((F.sum("total") / F.max("n")).alias("avg"))


def idf(df: Column, n: Column, smooth: bool = False) -> Column:
    k = 1 if smooth else 0
    return F.log(1 + (n + k - (df + k) + 0.5) / (df + k + 0.5))


def normed(w: DataFrame, norm: str | None) -> DataFrame:
    """Rows of weights with unit length; rows of zeros stay."""
    if norm is None:
        return w
    by = Window.partitionBy("repo_id", "idx")
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(by)) if norm == "l2" else F.sum(F.abs("w")).over(by)
    return w.withColumn("w", F.when(size == 0, F.col("w")).otherwise(F.col("w") / size))


@dataclass
class BM25Model:
    """Weights of count rows: fit learns idf and the mean length, transform applies them.

    Terms that fit has not seen are dropped. ``use_idf=False`` leaves idf out; ``sublinear`` is
    used when ``bm25_tf`` is off.
    """

    norm: str | None = "l2"
    use_idf: bool = True
    smooth_idf: bool = False
    sublinear: bool = False
    bm25_tf: bool = True
    k1: float = 1.2
    b: float = 0.75
    idf_: DataFrame | None = field(default=None, repr=False)

    def fit(self, tf: DataFrame, n: DataFrame) -> BM25Model:
        df = document_frequency(tf).join(n, "repo_id")
        self.idf_ = df.select("repo_id", "term", idf(F.col("df"), F.col("n"), self.smooth_idf).alias("idf"))
        return self

    def transform(self, tf: DataFrame, n: DataFrame) -> DataFrame:
        if self.use_idf and self.idf_ is None:
            raise ValueError("fit comes first")
        rows = tf.select("repo_id", "idx", "term", F.col("tf").cast("double").alias("tf"))
        if self.bm25_tf:
            # the mean reaches the rows through the lengths of the files
            lengths = rows.groupBy("repo_id", "idx").agg(F.sum("tf").alias("len"))
            mean = lengths.groupBy("repo_id").agg(F.sum("len").alias("total")).join(n, "repo_id").select("repo_id", (F.col("total") / F.col("n")).alias("avg"))
            rows = rows.join(lengths.join(mean, "repo_id"), ["repo_id", "idx"])
            share = (1 - self.b) + self.b * F.col("len") / F.col("avg")
            rows = rows.withColumn("w", F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * share))
        else:
            rows = rows.withColumn("w", 1 + F.log("tf") if self.sublinear else F.col("tf"))
        if self.use_idf:
            rows = rows.join(self.idf_, ["repo_id", "term"]).withColumn("w", F.col("w") * F.col("idf"))
        return normed(rows.select("repo_id", "idx", "term", "w"), self.norm)


def bm25_weights(tf: DataFrame, n: DataFrame | None = None, norm: str | None = "l2") -> DataFrame:
    """Weights of the pruned counts, as the ordering uses them.

    ``tf`` is read twice and should be cut: once for the vocabulary, from which the mean length
    follows too, and once to be joined with it. Lengths and norms share one window per file.
    """
    terms = vocabulary(tf, n)
    rows = tf.drop("n_files").join(terms.join(mean_length(terms), "repo_id").drop("total"), ["repo_id", "term"])
    length = F.sum("tf").over(Window.partitionBy("repo_id", "idx"))
    tfw = F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg")))
    return normed(rows.withColumn("len", length).select("repo_id", "idx", "term", (tfw * idf(F.col("df"), F.col("n"))).alias("w")), norm)


def pair_similarity(w: DataFrame) -> DataFrame:
    """sim: S[i, j] adds up the weights in j of the terms that i has; the diagonal is included.

    An equi-join on (repo_id, term); its skew is that of a term's documents in one repository.
    The table of all pairs is for reports; the ordering builds S beside the solver instead.
    """
    q = w.select("repo_id", "term", F.col("idx").alias("i"))
    d = w.select("repo_id", "term", F.col("idx").alias("j"), "w")
    return q.join(d, ["repo_id", "term"]).groupBy("repo_id", "i", "j").agg(F.sum("w").alias("s"))


@dataclass
class Vectorizer:
    """Counts and BM25 weights of free text with the usual options.

    ``accents`` is False, True or "unicode" (marks go), or "ascii"; ``preprocessor`` replaces case and
    accents by an expression of one's own (text column -> text), ``tokens`` the pattern (text
    column -> array), a callable ``analyzer`` everything (text column -> array of terms).
    Fractions in ``min_df`` / ``max_df`` are shares of the documents of a group.

    :meth:`fit` learns vocabulary and idf of docs(repo_id, idx, text), :meth:`transform` gives
    weights(repo_id, idx, term, w) in that vocabulary, :meth:`fit_transform` both.
    """

    lowercase: bool = True
    accents: bool | str = False
    pattern: str = X.TERM
    ngram_range: tuple[int, int] = (1, 1)
    analyzer: str | Callable[[Column], Column] = "word"
    binary: bool = False
    min_df: int | float = 1
    max_df: int | float = 1.0
    max_features: int | None = None
    stop_words: tuple[str, ...] = ()
    preprocessor: Callable[[Column], Column] | None = None
    tokens: Callable[[Column], Column] | None = None
    model: BM25Model = field(default_factory=lambda: BM25Model(smooth_idf=True))
    vocabulary_: DataFrame | None = field(default=None, repr=False)

    def units(self, t: Column) -> Column:
        """The terms of a text, an array."""
        if callable(self.analyzer):
            return self.analyzer(t)
        if self.preprocessor:
            t = self.preprocessor(t)
        else:
            t = F.lower(t) if self.lowercase else t
            t = X.strip_accents(t, "unicode" if self.accents is True else self.accents) if self.accents else t
        low, high = self.ngram_range
        if self.analyzer == "char":
            return X.char_ngrams(t, low, high)
        units = self.tokens(t) if self.tokens else F.regexp_extract_all(t, F.lit(self.pattern), F.lit(1))
        if self.stop_words:
            units = F.filter(units, lambda x: ~x.isin(*self.stop_words))
        return units if (low, high) == (1, 1) else X.ngrams(units, low, high)

    def raw_counts(self, docs: DataFrame) -> DataFrame:
        """tf of all terms; null texts have none. Counted inside the row, without a shuffle."""
        once = F.lit(1).cast("long")
        rows = docs.select("repo_id", "idx", F.inline(X.counted(self.units(F.col("text")))).alias("term", "tf"))
        return rows.withColumn("tf", once) if self.binary else rows

    def counts(self, docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
        """tf over docs(repo_id, idx, text) within the cut-offs, or within a given vocabulary(term)."""
        tf = self.raw_counts(docs)
        if vocabulary is not None:
            return tf.join(vocabulary.select("term").distinct(), "term", "left_semi").select("repo_id", "idx", "term", "tf")
        return self.limited(tf, sizes(docs))

    def limited(self, tf: DataFrame, n: DataFrame) -> DataFrame:
        return tf.join(self.kept(tf, n), ["repo_id", "term"], "left_semi").select("repo_id", "idx", "term", "tf")

    def kept(self, tf: DataFrame, n: DataFrame) -> DataFrame:
        """(repo_id, term) within the cut-offs."""
        of = lambda x: F.col("n") * x if isinstance(x, float) else F.lit(x)
        keep = tf.groupBy("repo_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).join(n, "repo_id")
        keep = keep.where((F.col("df") >= of(self.min_df)) & (F.col("df") <= of(self.max_df)))
        if self.max_features:
            rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("total"), "term"))
            keep = keep.withColumn("rank", rank).where(F.col("rank") <= self.max_features)
        return keep.select("repo_id", "term")

    def fit(self, docs: DataFrame, vocabulary: DataFrame | None = None) -> Vectorizer:
        """Learns (repo_id, term) and idf; ``vocabulary`` (term) replaces the cut-offs."""
        tf, n = cut(self.raw_counts(docs)), sizes(docs)
        if vocabulary is not None:
            self.vocabulary_ = tf.join(vocabulary.select("term").distinct(), "term", "left_semi").select("repo_id", "term").distinct()
        else:
            self.vocabulary_ = self.kept(tf, n)
        self.vocabulary_ = cut(self.vocabulary_)
        self.model.fit(tf.join(self.vocabulary_, ["repo_id", "term"], "left_semi"), n)
        self.model.idf_ = cut(self.model.idf_)
        return self

    def transform(self, docs: DataFrame) -> DataFrame:
        """weights(repo_id, idx, term, w) of documents in the learned vocabulary."""
        if self.vocabulary_ is None:
            raise ValueError("fit comes first")
        tf = cut(self.raw_counts(docs).join(self.vocabulary_, ["repo_id", "term"], "left_semi").select("repo_id", "idx", "term", "tf"))
        return self.model.transform(tf, sizes(docs))

    def fit_transform(self, docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
        return self.fit(docs, vocabulary).transform(docs)


def bm25_similarity(documents: DataFrame, id: str, text: str, group: str | None = None) -> DataFrame:
    """(group_id, a, b, s): the pair similarity of free texts, each group by itself.

    Words are cut by the usual pattern, case kept, and pruned as in the ordering. Without
    ``group`` all texts are one group. Null texts count as documents and match nothing.
    """
    name = F.col(group) if group else F.lit("")
    docs = documents.select(name.alias("repo_id"), F.col(id).alias("idx"), F.col(text).alias("text")).where("repo_id is not null")
    n = sizes(docs)
    # one row for ROWS documents at most, so it may be sent to all tasks; the others have their size from their rows
    large = F.broadcast(n.where(F.col("n") > blocks.ROWS))
    t = X.counted(Vectorizer(lowercase=False).units(F.col("text")))
    packed = docs.select("repo_id", "idx", t.alias("t")).join(large, "repo_id", "left").select("repo_id", "idx", "n", F.col("t.word").alias("terms"), F.col("t.n").alias("tf"))
    sim = blocks.similar(packed)
    return sim.select(F.col("repo_id").alias("group_id"), F.col("i").alias("a"), F.col("j").alias("b"), "s")
