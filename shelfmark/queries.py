"""Registered queries of the ordering engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.functions.stopwords import by_analyzer
from shelfmark.operators import blocks, bm25, combine, imports, metrics
from shelfmark.plans import ordering
from shelfmark.runtime import cut, table
from shelfmark.sources.files import presorted

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Shared inputs -----------------------------------------------------------------------------


def files_(spark: SparkSession, d: str) -> DataFrame:
    return presorted(table(spark, d, "repo_files").select("file_id", "repo_id", "path", "language", "content"))


def stop_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stopwords")


def plan_(spark: SparkSession, d: str, null_as_empty: bool = False) -> ordering.Ordering:
    return ordering.Ordering(table(spark, d, "repo_files").select("file_id", "repo_id", "path", "language", "content"), stop_(spark, d), null_as_empty=null_as_empty)


def six(c: str) -> Column:
    """A positive number with six digits, as SQL rounds it; F.round goes through decimals and takes most of the time of many rows."""
    return F.floor(F.col(c) * 1e6 + 0.5) / 1e6


# Files of repositories that content analysis takes: no null content, more than two files.
WHOLE = "n_files > 2 and not no_content"


def counts_(spark: SparkSession, d: str, null_as_empty: bool = False) -> DataFrame:
    p = plan_(spark, d, null_as_empty)
    return bm25.counts(p.texts(WHOLE), p.stopwords)


def tf_(spark: SparkSession, d: str, null_as_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Counts of terms and sizes of repositories."""
    p = plan_(spark, d, null_as_empty)
    return cut(bm25.counts(p.texts(WHOLE), p.stopwords)), p.conditions.where(WHOLE).select("repo_id", F.col("n_files").cast("long").alias("n"))


FILES = """
f0 AS (SELECT file_id, repo_id, CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS path, language, content FROM repo_files),
files AS (SELECT *, (row_number() OVER (PARTITION BY repo_id ORDER BY path, file_id) - 1)::INT AS idx, (count(*) OVER (PARTITION BY repo_id))::INT AS n_files FROM f0)"""
ANALYZER = "CASE " + " ".join(f"WHEN language = '{a}' THEN '{b}'" for a, b in X.ANALYZERS.items()) + " ELSE 'default' END"
ONCE = "(" + ", ".join(f"'{x}'" for x in X.ONCE) + ")"
LISTS = {a: X.STOP_LISTS.get(a, (a,)) for a in sorted({*X.ANALYZERS.values(), "default"})}
STOP = "lists(analyzer, language) AS (VALUES " + ", ".join(f"('{a}', '{x}')" for a, ls in LISTS.items() for x in ls) + "),\nstop AS (SELECT DISTINCT analyzer, trim(word) AS word FROM stopwords JOIN lists USING (language) WHERE word IS NOT NULL AND trim(word) <> '')"
IDENT = r"[_a-zA-Z\x{80}-\x{FFFF}]+[0-9]*"
WORDS = f"""
raw AS (SELECT repo_id, idx, {ANALYZER} AS analyzer, unnest(regexp_extract_all(path || chr(10) || content, '{IDENT}')) AS word FROM src),
words AS (SELECT repo_id, idx, analyzer, word, CASE WHEN analyzer IN {ONCE} THEN 1 ELSE count(*) END AS n FROM raw GROUP BY repo_id, idx, analyzer, word)"""
STEM = """CASE WHEN word LIKE '%ies' THEN CASE WHEN word LIKE '%eies' OR word LIKE '%aies' THEN word ELSE left(word, length(word) - 3) || 'y' END
 WHEN word LIKE '%es' THEN CASE WHEN word LIKE '%ses' THEN word ELSE left(word, length(word) - 2) END
 WHEN word LIKE '%s' THEN CASE WHEN word LIKE '%ss' THEN word ELSE left(word, length(word) - 1) END ELSE word END"""
KEPT = f"""
stems AS (SELECT repo_id, idx, analyzer, {STEM} AS word, n FROM words),
kept AS (SELECT * FROM stems s WHERE length(word) > 2 AND NOT EXISTS (SELECT 1 FROM stop t WHERE t.analyzer = s.analyzer AND t.word = s.word))"""
BL = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
CAMEL = rf"""CASE WHEN regexp_matches(word, '[A-Z]') THEN list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(word, '([a-z])([A-Z])', '\1 \2', 'g'), '([^a-z ])([A-Z][a-z])', '\1 \2', 'g'), '{BL}', ' ', 'g'), ' '), lambda x: x <> '') ELSE [] END"""
PIECES = f"""
split AS (SELECT word, CASE WHEN len(c) > 1 THEN c ELSE []::VARCHAR[] END AS c, CASE WHEN len(s) > 1 THEN s ELSE []::VARCHAR[] END AS s
 FROM (SELECT word, {CAMEL} AS c, string_split(word, '_') AS s FROM (SELECT DISTINCT word FROM kept)))"""
BAG = r"""
bags AS (SELECT word, list_concat([word], list_filter(list_concat(list_concat(c, CASE WHEN len(c) > 1 THEN [array_to_string(c[2:], '')] ELSE [] END), list_concat(s, CASE WHEN len(s) > 1 THEN [array_to_string(s[2:], '')] ELSE [] END)), lambda x: length(x) > 2)) AS b FROM split),
tokens AS (SELECT word, unnest(list_concat(b, list_transform(b, lambda x: lower(x)))) AS token FROM bags),
terms AS (SELECT word, term, count(*) AS m FROM (SELECT word, unnest(regexp_extract_all(token, '[\p{L}\p{N}_]{2,}')) AS term FROM tokens) GROUP BY ALL),
tf AS (SELECT repo_id, idx, term, sum(n * m)::BIGINT AS tf FROM kept JOIN terms USING (word) GROUP BY ALL)"""
SRC = "src AS (SELECT * FROM files WHERE n_files > 2 AND repo_id NOT IN (SELECT repo_id FROM files WHERE content IS NULL))"
EVERY = "src AS (SELECT * REPLACE (coalesce(content, '') AS content) FROM files WHERE n_files > 2)"
TF = ",".join((FILES, SRC, STOP, WORDS, KEPT, PIECES, BAG)) + """,
n AS (SELECT repo_id, count(*) AS n FROM src GROUP BY 1),
df AS (SELECT repo_id, term, count(*) AS df FROM tf GROUP BY ALL),
vocab AS (SELECT * FROM df JOIN n USING (repo_id) WHERE df >= 2 AND df <= greatest(n - 1, 3)),
pruned AS (SELECT tf.*, df, n FROM tf JOIN vocab USING (repo_id, term)),
len AS (SELECT repo_id, idx, sum(tf) AS len FROM pruned GROUP BY ALL),
avg_ AS (SELECT repo_id, sum(len) / max(n)::DOUBLE AS avg FROM len JOIN n USING (repo_id) GROUP BY 1),
raw_w AS (SELECT p.repo_id, idx, term, tf, df, n, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) AS t, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf
 FROM pruned p JOIN len USING (repo_id, idx) JOIN avg_ a ON a.repo_id = p.repo_id),
w AS (SELECT repo_id, idx, term, t * idf / sqrt(sum(t * idf * t * idf) OVER (PARTITION BY repo_id, idx)) AS w FROM raw_w)"""
SIM = TF + """,
sim AS (SELECT q.repo_id, q.idx AS i, d.idx AS j, sum(d.w) AS s FROM w q JOIN w d USING (repo_id, term) GROUP BY ALL)"""


def every(sql: str) -> str:
    """The same with a null content as an empty one, so over all repositories of more than two files."""
    return sql.replace(SRC, EVERY)


# Preparation of files ------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT file_id, repo_id, idx, n_files, path FROM files")
def presort(spark, d):
    return files_(spark, d).select("file_id", "repo_id", "idx", "n_files", "path")


@query(f"WITH {FILES} SELECT file_id, length(path || chr(10) || content) AS n_chars, md5(path || chr(10) || content) AS digest FROM files WHERE content IS NOT NULL")
def doc_text(spark, d):
    t = X.document_text()
    return files_(spark, d).where("content is not null").select("file_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


@query(f"SELECT file_id, {ANALYZER} AS analyzer FROM repo_files")
def language_dispatch(spark, d):
    return table(spark, d, "repo_files").select("file_id", X.analyzer().alias("analyzer"))


@query(f"WITH {FILES}, t AS (SELECT file_id, unnest(regexp_extract_all(path || chr(10) || content, '{IDENT}')) AS word FROM files) SELECT file_id, word, count(*) AS n FROM t GROUP BY ALL")
def identifiers(spark, d):
    return files_(spark, d).select("file_id", F.explode(X.identifiers(X.document_text())).alias("word")).groupBy("file_id", "word").agg(F.count("*").alias("n"))


@query(f"WITH {FILES}, src AS (SELECT * FROM files), {WORDS} SELECT repo_id, idx, word, n::BIGINT AS n FROM words WHERE analyzer IN {ONCE}")
def identifiers_distinct(spark, d):
    return bm25.raw_words(files_(spark, d)).where(F.col("analyzer").isin(*X.ONCE)).select("repo_id", "idx", "word", "n")


DISTINCT = f"WITH {FILES}, src AS (SELECT * FROM files), {STOP}, {WORDS}, {KEPT}"


@query(f"WITH {FILES}, src AS (SELECT * FROM files), {WORDS} SELECT DISTINCT word, {STEM} AS stem FROM words")
def plural_stem(spark, d):
    return bm25.raw_words(files_(spark, d)).select("word").distinct().select("word", X.singular(F.col("word")).alias("stem"))


@query(f"WITH {STOP} SELECT analyzer, word FROM stop")
def stop_union(spark, d):
    return by_analyzer(stop_(spark, d))


@query(f"{DISTINCT} SELECT analyzer, word, sum(n)::BIGINT AS n FROM kept GROUP BY ALL")
def stop_filter(spark, d):
    return bm25.kept_words(bm25.raw_words(files_(spark, d)), stop_(spark, d)).groupBy("analyzer", "word").agg(F.sum("n").alias("n"))


def _kept(spark, d):
    return bm25.kept_words(bm25.raw_words(files_(spark, d)), stop_(spark, d)).select("word").distinct()


@query(f"{DISTINCT}, {PIECES} SELECT word, array_to_string(c, ' ') AS pieces FROM split WHERE len(c) > 1")
def camel_split(spark, d):
    c = X.camel_pieces(F.col("word"))
    return _kept(spark, d).where(F.size(c) > 1).select("word", F.array_join(c, " ").alias("pieces"))


@query(f"{DISTINCT}, {PIECES} SELECT word, array_to_string(c[2:], '') AS tail FROM split WHERE len(c) > 1")
def camel_trim(spark, d):
    c = X.camel_pieces(F.col("word"))
    return _kept(spark, d).where(F.size(c) > 1).select("word", X.tail(c).alias("tail"))


@query(f"{DISTINCT}, {PIECES} SELECT word, array_to_string(s, ' ') AS pieces FROM split WHERE len(s) > 1")
def snake_split(spark, d):
    s = X.snake_pieces(F.col("word"))
    return _kept(spark, d).where(F.size(s) > 1).select("word", F.array_join(s, " ").alias("pieces"))


@query(f"{DISTINCT}, {PIECES} SELECT word, array_to_string(s[2:], '') AS tail FROM split WHERE len(s) > 1")
def snake_trim(spark, d):
    s = X.snake_pieces(F.col("word"))
    return _kept(spark, d).where(F.size(s) > 1).select("word", X.tail(s).alias("tail"))


@query(f"{DISTINCT}, {PIECES}, {BAG} SELECT word, token, count(*) AS n FROM tokens GROUP BY ALL")
def keyword_bag(spark, d):
    return _kept(spark, d).select("word", F.explode(X.bag(F.col("word"))).alias("token")).groupBy("word", "token").agg(F.count("*").alias("n"))


@query(f"{DISTINCT}, {PIECES}, {BAG} SELECT word, term, m AS n FROM terms")
def retokenise(spark, d):
    return _kept(spark, d).select("word", F.explode(X.terms(X.bag(F.col("word")))).alias("term")).groupBy("word", "term").agg(F.count("*").alias("n"))


# Counts and weights --------------------------------------------------------------------------


@query(f"WITH {TF} SELECT repo_id, idx, term, tf FROM tf")
def term_counts(spark, d):
    return counts_(spark, d).select("repo_id", "idx", "term", "tf")


@query(every(f"WITH {TF} SELECT repo_id, idx, term, tf FROM tf"))
def term_counts_all(spark, d):
    """Null contents as empty ones: no repository is left out, the largest least of all."""
    return counts_(spark, d, True).select("repo_id", "idx", "term", "tf")


@query(f"WITH {TF} SELECT repo_id, term, df FROM df")
def doc_freq(spark, d):
    return bm25.document_frequency(counts_(spark, d))


@query(f"WITH {TF} SELECT repo_id, idx, term, tf FROM pruned")
def vocab_prune(spark, d):
    return bm25.pruned(tf_(spark, d)[0]).select("repo_id", "idx", "term", "tf")


@query(f"WITH {TF} SELECT repo_id, idx, len::BIGINT AS len FROM len")
def doc_length(spark, d):
    return bm25.pruned(tf_(spark, d)[0]).groupBy("repo_id", "idx").agg(F.sum("tf").alias("len"))


@query(f"WITH {TF} SELECT repo_id, round(avg, 6) AS avg_len FROM avg_")
def avg_length(spark, d):
    return bm25.mean_length(bm25.vocabulary(counts_(spark, d))).select("repo_id", F.round("avg", 6).alias("avg_len"))


def _pruned(spark, d):
    """Pruned counts and sizes; the sizes may also come from a table of their own."""
    tf, n = tf_(spark, d)
    return bm25.pruned(tf.drop("n_files"), n).select("repo_id", "idx", "term", "tf"), n


@query(f"WITH {TF} SELECT repo_id, term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM vocab")
def idf(spark, d):
    return bm25.BM25Model().fit(*_pruned(spark, d)).idf_.select("repo_id", "term", F.round("idf", 6).alias("idf"))


@query(f"WITH {TF} SELECT repo_id, term, round(ln(1 + (n + 1 - (df + 1) + 0.5::DOUBLE) / (df + 1 + 0.5::DOUBLE)), 6) AS idf FROM vocab")
def idf_smooth(spark, d):
    return bm25.BM25Model(smooth_idf=True).fit(*_pruned(spark, d)).idf_.select("repo_id", "term", F.round("idf", 6).alias("idf"))


def _weights(spark, d, **options):
    counts, n = _pruned(spark, d)
    counts = cut(counts)
    w = bm25.BM25Model(**options).fit(counts, n).transform(counts, n)
    return w.select("repo_id", "idx", "term", F.round("w", 6).alias("w"))


@query(f"WITH {TF} SELECT repo_id, idx, term, round(t, 6) AS w FROM raw_w")
def bm25_tf(spark, d):
    return _weights(spark, d, norm=None, use_idf=False)


@query(f"WITH {TF} SELECT repo_id, idx, term, round((1 + ln(tf)) * idf, 6) AS w FROM raw_w")
def sublinear_tf(spark, d):
    return _weights(spark, d, norm=None, bm25_tf=False, sublinear=True)


@query(f"WITH {TF} SELECT repo_id, idx, term, round(t * idf / sum(abs(t * idf)) OVER (PARTITION BY repo_id, idx), 6) AS w FROM raw_w")
def norm_l1(spark, d):
    p = plan_(spark, d)
    w = blocks.weights(bm25.packed(p.texts(WHOLE), p.stopwords, split=True), p.conditions.count() <= 100_000, "l1")
    return w.select("repo_id", "idx", "term", F.round("w", 6).alias("w"))


NORM_L2 = f"WITH {TF} SELECT repo_id, idx, term, round(w, 6) AS w FROM w"


@query(NORM_L2)
def norm_l2(spark, d):
    return bm25.bm25_weights(tf_(spark, d)[0]).select("repo_id", "idx", "term", F.round("w", 6).alias("w"))


@query(every(NORM_L2))
def norm_l2_all(spark, d):
    return bm25.bm25_weights(tf_(spark, d, True)[0]).select("repo_id", "idx", "term", F.round("w", 6).alias("w"))


def _packed(spark, d, null_as_empty=False):
    p = plan_(spark, d, null_as_empty)
    return bm25.packed(p.texts(WHOLE), p.stopwords)


def _sim(spark, d, null_as_empty=False):
    return blocks.similar(_packed(spark, d, null_as_empty))


@query(f"WITH {SIM} SELECT repo_id, i, j, round(s, 6) AS s FROM sim")
def pair_similarity(spark, d):
    return _sim(spark, d).select("repo_id", "i", "j", six("s").alias("s"))


@query(every(f"WITH {SIM} SELECT repo_id, i, j, round(s, 6) AS s FROM sim"))
def pair_similarity_all(spark, d):
    return _sim(spark, d, True).select("repo_id", "i", "j", six("s").alias("s"))


SCALE = """
nn AS (SELECT repo_id, max(n) AS n, max(s) AS top, count(s) AS nnz FROM n LEFT JOIN sim USING (repo_id) GROUP BY 1),
padded AS (SELECT repo_id, s FROM sim UNION ALL SELECT repo_id, 0::DOUBLE FROM nn, unnest(range(0, (n * n - nnz)::BIGINT)) t(k)),
p95 AS (SELECT repo_id, quantile_cont(s, 0.95) AS p FROM padded GROUP BY 1),
scale AS (SELECT repo_id, greatest(0.01::DOUBLE, coalesce(CASE WHEN n < 10 THEN top ELSE p END, 0.01::DOUBLE)) AS scale FROM nn LEFT JOIN p95 USING (repo_id))"""


def _scaled(spark, d, null_as_empty=False):
    """S and its scale."""
    tf, n = tf_(spark, d, null_as_empty)
    sim = cut(bm25.pair_similarity(cut(bm25.bm25_weights(tf))))
    return sim, combine.boost_scale(sim, n)


def _scales(spark, d, null_as_empty=False):
    """The scale without a table of S; of repositories without terms the least."""
    p = plan_(spark, d, null_as_empty)
    found = blocks.scales(bm25.packed(p.texts(WHOLE), p.stopwords))
    return p.conditions.where(WHOLE).select("repo_id").join(found, "repo_id", "left").select("repo_id", F.coalesce("scale", F.lit(blocks.FLOOR)).alias("scale"))


@query(f"WITH {SIM}, {SCALE} SELECT repo_id, round(scale, 6) AS scale FROM scale")
def boost_scale(spark, d):
    return _scales(spark, d).select("repo_id", F.round("scale", 6).alias("scale"))


@query(every(f"WITH {SIM}, {SCALE} SELECT repo_id, round(scale, 6) AS scale FROM scale"))
def boost_scale_all(spark, d):
    return _scales(spark, d, True).select("repo_id", F.round("scale", 6).alias("scale"))


AUG = """
back AS (SELECT repo_id, to_file AS from_file, from_file AS to_file, 0.25 * weight AS weight FROM edges WHERE language = 'Python'),
num AS (SELECT *, row_number() OVER (PARTITION BY repo_id, from_file ORDER BY to_file, weight) AS k FROM edges WHERE from_file <> to_file),
sib AS (SELECT a.repo_id, a.to_file AS from_file, b.to_file, 0.5::DOUBLE AS weight FROM num a JOIN num b ON a.repo_id = b.repo_id AND a.from_file = b.from_file AND a.k <> b.k),
aug AS (SELECT repo_id, from_file, to_file, sum(weight) AS weight FROM (SELECT repo_id, from_file, to_file, weight FROM edges UNION ALL SELECT * FROM back UNION ALL SELECT * FROM sib) GROUP BY ALL)"""
GRAPH = """
path_at AS (SELECT repo_id, path, min(idx) AS k FROM files GROUP BY ALL),
graph AS (SELECT e.repo_id, a.k AS i, b.k AS j, sum(weight) AS g FROM aug e JOIN path_at a ON a.repo_id = e.repo_id AND a.path = from_file JOIN path_at b ON b.repo_id = e.repo_id AND b.path = to_file GROUP BY ALL)"""


def _graph(spark, d):
    return imports.indexed(imports.augmented(table(spark, d, "edges")), files_(spark, d))


@query(f"WITH {SIM}, {SCALE}, {AUG}, {GRAPH} SELECT repo_id, i, j, round(sum(s), 6) AS s FROM (SELECT * FROM sim UNION ALL SELECT repo_id, i, j, g * scale FROM graph JOIN scale USING (repo_id)) WHERE i <> j GROUP BY ALL")
def boosted_similarity(spark, d):
    sim, scale = _scaled(spark, d)
    b = combine.boosted(sim, _graph(spark, d), scale)
    return b.select("repo_id", "i", "j", F.round("s", 6).alias("s"))


@query(f"WITH {SIM} SELECT repo_id, i, j, round(s, 6) AS s FROM sim WHERE i <> j")
def zero_diagonal(spark, d):
    return _sim(spark, d).where("i <> j").select("repo_id", "i", "j", F.round("s", 6).alias("s"))


# Imports ---------------------------------------------------------------------------------------


@query()
def import_extract(spark, d):
    return imports.extracted(files_(spark, d)).select("repo_id", "path", "pos", "module", "level", "name")


RESOLVE = f"""WITH {FILES}, f AS (SELECT *, regexp_replace(to_file, '/[^/]*$', '') AS dir, replace(module, '.', '/') AS rest FROM imports),
c AS (SELECT *, unnest(['/' || ltrim(dir || '/' || rest, '/') || '.py', '/' || ltrim(dir || '/' || rest, '/') || '/__init__.py', '/' || rest || '.py', '/' || rest || '/__init__.py']) AS path, unnest([0, 1, 2, 3]) AS prio FROM f),
known AS (SELECT DISTINCT repo_id, path FROM files WHERE language = 'Python'),
hit AS (SELECT repo_id, to_file, seq AS pos, module, name, min_by(path, prio) AS found FROM c JOIN known USING (repo_id, path) GROUP BY ALL)"""


def _resolved(spark, d):
    facts = table(spark, d, "imports").select("repo_id", F.col("to_file").alias("path"), F.col("seq").cast("int").alias("pos"), "module", F.lit(0).alias("level"), "name")
    return imports.resolved(imports.with_candidates(facts).distinct(), files_(spark, d))


@query(f"{RESOLVE} SELECT DISTINCT repo_id, to_file, module, found AS from_file FROM hit")
def module_resolve(spark, d):
    """The file that each module of the import facts means, looked up among the files."""
    return _resolved(spark, d).select("repo_id", "to_file", "module", "from_file").distinct()


@query(f"{RESOLVE} SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY to_file, pos) AS seq, name, module, found AS from_file, to_file FROM hit")
def resolved_rows(spark, d):
    """Import rows from the import facts, numbered in file order."""
    return _resolved(spark, d)


@query()
def import_rows(spark, d):
    return imports.import_rows(files_(spark, d))


@query(
    """WITH own AS (SELECT repo_id, name, to_file AS from_file, max_by(from_file, seq) AS deeper FROM imports GROUP BY ALL),
star AS (SELECT repo_id, from_file, deeper AS through_star FROM own WHERE name = '*')
SELECT i.repo_id, i.seq, i.name, i.module, coalesce(deeper, through_star) AS from_file, i.to_file FROM imports i
LEFT JOIN own o ON o.repo_id = i.repo_id AND o.name = i.name AND o.from_file = i.from_file LEFT JOIN star s ON s.repo_id = i.repo_id AND s.from_file = i.from_file
WHERE coalesce(deeper, through_star) <> i.to_file"""
)
def name_transit(spark, d):
    """One round of looking names up through the defining files' own imports."""
    return imports.one_round(table(spark, d, "imports"))


@query(
    f"""WITH {FILES}, tok AS (SELECT DISTINCT repo_id, path, unnest(regexp_extract_all(content, '[_a-zA-Z0-9]+')) AS name FROM files)
SELECT i.* FROM imports i WHERE EXISTS (SELECT 1 FROM tok t WHERE t.repo_id = i.repo_id AND t.path = i.from_file AND t.name = i.name)"""
)
def name_occurs(spark, d):
    i = table(spark, d, "imports")
    return imports.name_occurs(i, files_(spark, d)).select(*i.columns)


def _rounds(n: int) -> str:
    out = ["r0 AS (SELECT DISTINCT repo_id, seq, name, module, from_file, to_file FROM imports)"]
    for k in range(n):
        out.append(f"""own{k} AS (SELECT repo_id, name, to_file AS from_file, max_by(from_file, seq) AS deeper FROM r{k} GROUP BY ALL),
top{k} AS (SELECT repo_id, max(seq) AS top FROM r{k} GROUP BY ALL),
more{k} AS (SELECT i.repo_id, top + i.seq AS seq, i.name, i.module, coalesce(o.deeper, s.deeper) AS from_file, i.to_file FROM r{k} i JOIN top{k} t ON t.repo_id = i.repo_id
 LEFT JOIN own{k} o ON o.repo_id = i.repo_id AND o.name = i.name AND o.from_file = i.from_file LEFT JOIN own{k} s ON s.repo_id = i.repo_id AND s.from_file = i.from_file AND s.name = '*'),
held{k} AS (SELECT m.* FROM more{k} m JOIN tok t ON t.repo_id = m.repo_id AND t.path = m.from_file AND t.name = m.name WHERE m.from_file <> m.to_file),
r{k + 1} AS (SELECT repo_id, max(seq) AS seq, name, max_by(module, seq) AS module, from_file, to_file FROM (SELECT * FROM r{k} UNION ALL SELECT * FROM held{k}) GROUP BY repo_id, name, from_file, to_file)""")
    return ",\n".join(out)


@query(
    f"""WITH {FILES}, last AS (SELECT repo_id, path, max_by(content, idx) FILTER (content IS NOT NULL) AS c, max(idx) AS k FROM files WHERE language = 'Python' GROUP BY ALL),
tok AS (SELECT DISTINCT f.repo_id, f.path, unnest(regexp_extract_all(content, '[_a-zA-Z0-9]+')) AS name FROM files f JOIN last l ON l.repo_id = f.repo_id AND l.k = f.idx),
{_rounds(3)} SELECT * FROM r3"""
)
def propagate_names(spark, d):
    return imports.propagated(table(spark, d, "imports"), files_(spark, d))


@query()
def import_edges(spark, d):
    """From the files themselves: syntax, resolution, three rounds of names, edges."""
    return imports.import_edges(files_(spark, d))


@query("SELECT DISTINCT repo_id, from_file, to_file, 1::DOUBLE AS weight, 'Python' AS language FROM imports")
def edge_emit(spark, d):
    return imports.edges_of(table(spark, d, "imports"))


@query("SELECT repo_id, to_file AS from_file, from_file AS to_file, 0.25 * weight AS weight, language FROM edges WHERE language = 'Python'")
def backward_edges(spark, d):
    return imports.backward(table(spark, d, "edges"))


@query(f"WITH {AUG} SELECT repo_id, from_file, to_file, weight FROM sib")
def sibling_edges(spark, d):
    return imports.siblings(table(spark, d, "edges")).select("repo_id", "from_file", "to_file", "weight")


@query("SELECT * FROM edges WHERE from_file <> to_file")
def drop_self_edges(spark, d):
    return imports.without_self(table(spark, d, "edges"))


@query(f"WITH {AUG} SELECT repo_id, from_file, to_file, weight FROM aug")
def augmented_edges(spark, d):
    return imports.augmented(table(spark, d, "edges")).select("repo_id", "from_file", "to_file", "weight")


@query(f"WITH {FILES}, {AUG}, {GRAPH} SELECT repo_id, i, j, g FROM graph")
def graph_matrix(spark, d):
    return _graph(spark, d)


@query(f"WITH {FILES} SELECT file_id, len(list_distinct(regexp_extract_all(content, '[_a-zA-Z0-9]+'))) AS n FROM files WHERE content IS NOT NULL")
def word_token_sets(spark, d):
    return files_(spark, d).where("content is not null").select("file_id", F.size(X.word_tokens(F.col("content"))).cast("long").alias("n"))


# Orders ------------------------------------------------------------------------------------------


def _ordered(spark, d):
    return plan_(spark, d).result()


@query()
def order_files(spark, d):
    return _ordered(spark, d).select("repo_id", "pos", "idx", "path", F.round("matching_score", 6).alias("matching_score"), "status")


@query("SELECT repo_id, count(*) AS n_files, count(*) AS n_pos, 0 AS first_pos, (count(*) - 1)::INT AS last_pos, count(*) AS n_idx FROM repo_files GROUP BY 1")
def order_invariants(spark, d):
    o = _ordered(spark, d)
    return o.groupBy("repo_id").agg(
        F.count("*").alias("n_files"), F.countDistinct("pos").alias("n_pos"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.countDistinct("idx").alias("n_idx")
    )


@query(
    f"""WITH {SIM}, o AS (SELECT repo_id, idx, coalesce(lead(idx) OVER (PARTITION BY repo_id ORDER BY idx), lag(idx) OVER (PARTITION BY repo_id ORDER BY idx)) AS j FROM src)
SELECT o.repo_id, o.idx AS pos, round(coalesce(s, 0), 6) AS matching_score FROM o LEFT JOIN sim ON sim.repo_id = o.repo_id AND sim.i = o.idx AND sim.j = o.j"""
)
def matching_scores(spark, d):
    """Scores of the path order."""
    p = plan_(spark, d)
    sim = bm25.pair_similarity(cut(bm25.bm25_weights(cut(bm25.counts(p.texts(WHOLE), p.stopwords)))))
    f = p.some(WHOLE).select("repo_id", F.col("idx").alias("pos"), "idx")
    return metrics.matching_scores(f, sim).select("repo_id", "pos", F.round("matching_score", 6).alias("matching_score"))


@query(
    f"""WITH {TF}, l AS (SELECT repo_id, count(*) AS n_files, max((content IS NULL)::INT) AS nc, max((content IS NULL AND language = 'Python')::INT) AS p, max((language IS NULL)::INT) AS ln, max((language IS NOT NULL)::INT) AS lo FROM files GROUP BY 1),
g AS (SELECT *, coalesce(p, 0) = 1 OR (ln = 1 AND lo = 1) AS no_graph, n_files = 2 OR repo_id IN (SELECT repo_id FROM vocab) AS has_s FROM l)
SELECT repo_id, n_files, CASE WHEN n_files = 1 OR n_files > 10000 THEN 'lexicographic_size' WHEN NOT has_s AND no_graph THEN 'lexicographic_error' WHEN n_files = 2 THEN 'pair'
 WHEN NOT has_s THEN 'ordered_static_only' WHEN no_graph THEN 'ordered_content_only' ELSE 'ordered' END AS status FROM g"""
)
def order_statuses(spark, d):
    """What became of each repository."""
    return _ordered(spark, d).groupBy("repo_id", "status").agg(F.count("*").alias("n_files"))


@query()
def order_metrics(spark, d):
    """Connections found on the way, and how well the orders follow them."""
    return plan_(spark, d).metrics()


@query("SELECT repo_id, round(median(matching_score), 6) AS coherence_score FROM ordered GROUP BY 1")
def coherence(spark, d):
    return metrics.coherence(table(spark, d, "ordered")).select("repo_id", F.round("coherence_score", 6).alias("coherence_score"))


METRICS = """
size AS (SELECT repo_id, count(*)::INT AS n_files FROM ordered GROUP BY 1),
links AS (SELECT repo_id, ltrim(from_file, '/') AS a, ltrim(to_file, '/') AS b FROM edges),
nc AS (SELECT repo_id, count(*)::INT AS n_connections FROM links GROUP BY 1),
steps AS (SELECT DISTINCT repo_id, a, b FROM (SELECT repo_id, ltrim(path, '/') AS a, lead(ltrim(path, '/')) OVER (PARTITION BY repo_id ORDER BY pos) AS b FROM ordered) WHERE b IS NOT NULL),
inter AS (SELECT repo_id, count(*) AS c FROM (SELECT * FROM steps INTERSECT SELECT * FROM links) GROUP BY 1),
uni AS (SELECT repo_id, count(*) AS u FROM (SELECT * FROM steps UNION SELECT * FROM links) GROUP BY 1),
m AS (SELECT repo_id, n_files, coalesce(n_connections, 0) AS n_connections, coalesce(c, 0) AS c, u FROM size LEFT JOIN nc USING (repo_id) LEFT JOIN inter USING (repo_id) LEFT JOIN uni USING (repo_id))"""


@query(
    f"""WITH {METRICS} SELECT repo_id, n_files, n_connections, CASE WHEN n_files > 1 THEN round(c / u, 6) END AS jaccard, CASE WHEN n_files > 1 THEN round(c / (n_files - 1), 6) END AS recall,
CASE WHEN n_files > 1 AND n_connections > 0 THEN round(greatest(c / (n_files - 1), c / n_connections), 6) END AS connection_score FROM m"""
)
def connection_metrics(spark, d):
    m = metrics.connection_metrics(table(spark, d, "ordered"), table(spark, d, "edges"))
    return m.select("repo_id", "n_files", "n_connections", *[F.round(c, 6).alias(c) for c in ("jaccard", "recall", "connection_score")])


@query("SELECT repo_id, pos, ltrim(path, '/') AS from_file, b AS to_file FROM (SELECT *, lead(ltrim(path, '/')) OVER (PARTITION BY repo_id ORDER BY pos) AS b FROM ordered) WHERE b IS NOT NULL")
def adjacent_pairs(spark, d):
    return metrics.adjacent(table(spark, d, "ordered"))


@query(f"WITH {FILES} SELECT repo_id, n_files, n_files > 1 AND n_files <= 100 AS gate FROM files GROUP BY ALL")
def size_gate(spark, d):
    return ordering.gated(files_(spark, d), 100).select("repo_id", "n_files", "gate").distinct()


@query(
    f"""WITH {FILES}, l AS (SELECT repo_id, max((content IS NULL)::INT)::BOOLEAN AS no_content, max((content IS NULL AND language = 'Python')::INT) AS p, max((language IS NULL)::INT) AS ln, max((language IS NOT NULL)::INT) AS lo FROM files GROUP BY 1)
SELECT repo_id, no_content, coalesce(p, 0) = 1 OR (ln = 1 AND lo = 1) AS no_graph FROM l"""
)
def failure_conditions(spark, d):
    return ordering.conditions(ordering.gated(files_(spark, d))).select("repo_id", "no_content", "no_graph")


@query(f"WITH {FILES} SELECT repo_id, idx, 'pair' AS status FROM files WHERE n_files = 2")
def two_file_shortcut(spark, d):
    return _ordered(spark, d).where("status = 'pair'").select("repo_id", "idx", "status")


@query(
    f"""WITH {TF}, l AS (SELECT repo_id, count(*) AS n_files, max((content IS NULL AND language = 'Python')::INT) AS p, max((language IS NULL)::INT) AS ln, max((language IS NOT NULL)::INT) AS lo FROM files GROUP BY 1)
SELECT repo_id, n_files, n_files AS n_pos, 0::BIGINT AS n_scores FROM l WHERE n_files > 2 AND n_files <= 10000 AND repo_id NOT IN (SELECT repo_id FROM vocab) AND NOT (coalesce(p, 0) = 1 OR (ln = 1 AND lo = 1))"""
)
def static_only_fallback(spark, d):
    """Repositories without similarity: ordered by connections alone, without scores."""
    o = _ordered(spark, d).where("status = 'ordered_static_only'")
    return o.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.countDistinct("pos").alias("n_pos"), F.count("matching_score").alias("n_scores"))


@query("SELECT repo_id, count(*) AS n_files FROM repo_files GROUP BY 1 HAVING bool_or(language = 'Python') AND count(*) > 10")
def python_repo_filter(spark, d):
    r = table(spark, d, "repo_files").groupBy("repo_id").agg(F.bool_or(F.col("language") == "Python").alias("p"), F.count("*").alias("n_files"))
    return r.where("p and n_files > 10").select("repo_id", "n_files")


@query("SELECT repo_id, path, language, md5(content) AS digest FROM repo_files")
def flatten_files(spark, d):
    from shelfmark.sources.files import flat, nested

    return flat(nested(table(spark, d, "repo_files").select("repo_id", "path", "language", "content"))).select("repo_id", "path", "language", F.md5("content").alias("digest"))


@query(
    """WITH f AS (SELECT *, row_number() OVER (ORDER BY file_id) - 1 AS k FROM repo_files), n AS (SELECT count(*) AS n FROM repo_files)
SELECT f.file_id, repo_id, path FROM (SELECT (((r + 7) * 48271 % 2147483647) * 69621 % 2147483647) % n AS k FROM range(1, 1001) t(r), n) JOIN f USING (k)"""
)
def sample_files(spark, d):
    """A thousand files with replacement; the size is the feature."""
    from shelfmark.sources.files import sample

    return sample(table(spark, d, "repo_files").select("file_id", "repo_id", "path"), 1000, "file_id", seed=7)


# Vectorizer options over documents -----------------------------------------------------------------


def _docs(spark, d):
    return table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("repo_id"), F.col("doc_id").alias("idx"), "text").where("text is not null")


DOCS = "docs AS (SELECT coalesce(source, '') AS repo_id, doc_id AS idx, text FROM documents WHERE text IS NOT NULL)"
DTF = DOCS + r""",
dt AS (SELECT repo_id, idx, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM docs),
dtf AS (SELECT repo_id, idx, term, count(*) AS tf FROM dt GROUP BY ALL),
dn AS (SELECT repo_id, count(*) AS n FROM docs GROUP BY 1),
ddf AS (SELECT repo_id, term, count(*) AS df FROM dtf GROUP BY ALL)"""
OUT = ["repo_id", "idx", "term", "tf"]


@query(
    rf"""WITH {DOCS}, t AS (SELECT repo_id, idx, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM docs),
g AS (SELECT repo_id, idx, unnest(t) AS term FROM t UNION ALL SELECT repo_id, idx, t[k] || ' ' || t[k + 1] FROM (SELECT *, unnest(range(1, len(t))) AS k FROM t))
SELECT repo_id, idx, term, count(*) AS tf FROM g GROUP BY ALL"""
)
def ngrams(spark, d):
    return bm25.Vectorizer(ngram_range=(1, 2)).counts(_docs(spark, d)).select(OUT)


@query(f"WITH {DOCS}, g AS (SELECT repo_id, idx, substring(t, k::INT, 3) AS term FROM (SELECT *, lower(text) AS t, unnest(range(1, length(lower(text)) - 1)) AS k FROM docs)) SELECT repo_id, idx, term, count(*) AS tf FROM g GROUP BY ALL")
def char_ngrams(spark, d):
    return bm25.Vectorizer(analyzer="char", ngram_range=(3, 3)).counts(_docs(spark, d)).select(OUT)


@query(f"WITH {DTF} SELECT repo_id, idx, term, 1::BIGINT AS tf FROM dtf")
def binary_tf(spark, d):
    return bm25.Vectorizer(binary=True).counts(_docs(spark, d)).select(OUT)


@query(
    f"""WITH {DTF}, r AS (SELECT repo_id, term, row_number() OVER (PARTITION BY repo_id ORDER BY sum(tf) DESC, term) AS k FROM dtf GROUP BY repo_id, term)
SELECT dtf.repo_id, idx, dtf.term, tf FROM dtf JOIN r ON r.repo_id = dtf.repo_id AND r.term = dtf.term WHERE k <= 50"""
)
def max_features(spark, d):
    return bm25.Vectorizer(max_features=50).counts(_docs(spark, d)).select(OUT)


@query(f"WITH {DTF} SELECT dtf.repo_id, idx, dtf.term, tf FROM dtf JOIN ddf ON ddf.repo_id = dtf.repo_id AND ddf.term = dtf.term JOIN dn ON dn.repo_id = dtf.repo_id WHERE df >= 2 AND df <= 0.5::DOUBLE * n")
def df_fraction_cutoffs(spark, d):
    return bm25.Vectorizer(min_df=2, max_df=0.5).counts(_docs(spark, d)).select(OUT)


@query()
def strip_accents(spark, d):
    """Decomposed by compatibility, which DuckDB's function of this name is not."""
    return table(spark, d, "documents").select("doc_id", X.strip_accents(F.col("text")).alias("text"))


VW = f"""{DTF}, dlen AS (SELECT repo_id, idx, sum(tf) AS len FROM dtf GROUP BY ALL), davg AS (SELECT repo_id, sum(len) / max(n)::DOUBLE AS avg FROM dlen JOIN dn USING (repo_id) GROUP BY 1),
draw AS (SELECT t.repo_id, idx, t.term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 1.5::DOUBLE)) AS w
 FROM dtf t JOIN dlen USING (repo_id, idx) JOIN davg USING (repo_id) JOIN ddf USING (repo_id, term) JOIN dn USING (repo_id))"""


@query(f"WITH {VW} SELECT repo_id, idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY repo_id, idx)), 6) AS w FROM draw")
def vectorizer_weights(spark, d):
    return bm25.Vectorizer().fit_transform(_docs(spark, d)).select("repo_id", "idx", "term", F.round("w", 6).alias("w"))


FREE = r"""
dt AS (SELECT coalesce(repo_id, '') AS g, doc_id AS idx, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT g, idx, term, count(*) AS tf FROM dt GROUP BY ALL),
n AS (SELECT coalesce(repo_id, '') AS g, count(*) AS n FROM documents GROUP BY 1),
vocab AS (SELECT g, term, df, n FROM (SELECT g, term, count(*) AS df FROM tf GROUP BY ALL) JOIN n USING (g) WHERE df >= 2 AND df <= greatest(n - 1, 3)),
p AS (SELECT g, idx, term, tf, df, n FROM tf JOIN vocab USING (g, term)),
l AS (SELECT g, idx, sum(tf) AS len FROM p GROUP BY ALL), a AS (SELECT g, sum(len) / max(n)::DOUBLE AS avg FROM l JOIN n USING (g) GROUP BY 1),
x AS (SELECT p.g, idx, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS w FROM p JOIN l USING (g, idx) JOIN a ON a.g = p.g),
w AS (SELECT g, idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, idx)) AS w FROM x)"""


@query(f"WITH {FREE} SELECT q.g AS group_id, q.idx AS a, v.idx AS b, round(sum(v.w), 6) AS s FROM w q JOIN w v USING (g, term) GROUP BY ALL")
def free_similarity(spark, d):
    """Similarity of free texts, within their repository."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.coalesce("repo_id", F.lit("")).alias("g"))
    return bm25.bm25_similarity(docs, "doc_id", "text", "g").withColumn("s", six("s"))


@query(f"WITH {DTF} SELECT repo_id, idx, term, tf FROM dtf WHERE term IN (SELECT DISTINCT lower(trim(word)) FROM stopwords)")
def fixed_vocabulary(spark, d):
    vocabulary = stop_(spark, d).select(F.lower(F.trim("word")).alias("term"))
    return bm25.Vectorizer().counts(_docs(spark, d), vocabulary).select(OUT)


@query("SELECT repo_id, path, pos FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS k FROM ordered) WHERE k <= 30")
def head(spark, d):
    """The first thirty files of each order."""
    k = F.row_number().over(Window.partitionBy("repo_id").orderBy("pos"))
    return table(spark, d, "ordered").withColumn("k", k).where("k <= 30").select("repo_id", "path", "pos")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
