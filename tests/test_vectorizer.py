"""Counts inside rows, accents, vectorizer and free texts, the percentile in two passes."""

import collections
import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators import bm25, combine, imports
from shelfmark.operators.solver import connections, scale_of, similarities, step_scores

TEXTS = ["b a b c", "", None, "a", "zz yy zz zz"]


def test_counted(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = df.select("k", F.inline(X.counted(F.regexp_extract_all("t", F.lit(r"(\w+)"), F.lit(1)))).alias("word", "n")).collect()
    want = {(k, w): n for k, t in enumerate(TEXTS) for w, n in collections.Counter(re.findall(r"\w+", t or "")).items()}
    assert {(r.k, r.word): r.n for r in got} == want


def test_accents(spark):
    texts = ["plain", "Crème Brûlée", "ﬁn ½ ㎏ Å ǅ", "é 한글 ひが゙", "—“quoted”…", None, "", "Ωμέγα й"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(X.strip_accents(F.col("t")), X.strip_accents(F.col("t"), "ascii")).collect()]
    apart = [None if t is None else unicodedata.normalize("NFKD", t) for t in texts]
    assert [g[0] for g in got] == [None if t is None else "".join(c for c in t if not unicodedata.combining(c)) for t in apart]
    assert [g[1] for g in got] == [None if t is None else t.encode("ascii", "ignore").decode() for t in apart]
    with pytest.raises(ValueError):
        X.strip_accents(F.col("t"), "latin")


DOCS = [("g", 0, "Été the cat"), ("g", 1, "cat cat dog"), ("g", 2, None), ("g", 3, "dog the ete"), ("h", 9, "cat")]


def test_vectorizer(spark):
    docs = spark.createDataFrame(DOCS, "repo_id string, idx int, text string")
    v = bm25.Vectorizer(accents="unicode", min_df=2, stop_words=("the",), model=bm25.BM25Model(norm=None, smooth_idf=True))
    got = {(r.repo_id, r.idx, r.term): r.w for r in v.fit_transform(docs).collect()}
    tf = {0: {"ete": 1, "cat": 1}, 1: {"cat": 2, "dog": 1}, 3: {"dog": 1, "ete": 1}}
    idf, mean = math.log(1 + (5 - 3 + 0.5) / 3.5), 7 / 4
    want = {("g", i, t): n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(ts.values()) / mean)) * idf for i, ts in tf.items() for t, n in ts.items()}
    assert got == pytest.approx(want)
    new = spark.createDataFrame([("g", 7, "dog bird dog")], "repo_id string, idx int, text string")
    assert {r.term for r in v.transform(new).collect()} == {"dog"}
    with pytest.raises(ValueError):
        bm25.Vectorizer().transform(docs)


def test_vectorizer_hooks(spark):
    docs = spark.createDataFrame([("g", 0, "A-b c-d"), ("g", 1, "a-B")], "repo_id string, idx int, text string")
    terms = lambda **o: {(r.idx, r.term, r.tf) for r in bm25.Vectorizer(**o).counts(docs).collect()}
    assert terms(analyzer=lambda t: F.split(t, " ")) == {(0, "A-b", 1), (0, "c-d", 1), (1, "a-B", 1)}
    assert terms(tokens=lambda t: F.split(t, "[- ]")) == {(0, x, 1) for x in "abcd"} | {(1, "a", 1), (1, "b", 1)}
    assert terms(preprocessor=lambda t: F.replace(t, F.lit("-"), F.lit("")), pattern=r"(\S+)") == {(0, "Ab", 1), (0, "cd", 1), (1, "aB", 1)}
    assert {r.term for r in bm25.Vectorizer(pattern=r"(\w)").fit(docs, spark.createDataFrame([("b",), ("x",)], "term string")).vocabulary_.collect()} == {"b"}


def test_free_texts(spark):
    docs = spark.createDataFrame([(1, "red fox", "k"), (2, "red fox", "k"), (3, "blue owl", "k"), (4, None, "k")], "doc_id long, text string, term string")
    got = {(r.a, r.b): r.s for r in bm25.bm25_similarity(docs, "doc_id", "text").collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)} and got[1, 2] == pytest.approx(2 / math.sqrt(2))


def test_percentile_in_two_passes(spark):
    r = np.random.RandomState(3)
    rows, want = [], {}
    for repo, n, share in (("many", 25, 0.6), ("few", 12, 0.03), ("ties", 14, 1.0), ("none", 11, 0.0), ("tiny", 4, 0.5)):
        s = r.rand(n, n) * (r.rand(n, n) < share) if repo != "ties" else np.ones((n, n))
        rows += [(repo, int(i), int(j), float(s[i, j])) for i, j in zip(*np.nonzero(s))]
        want[repo] = max(0.01, float(s.max() if n < 10 else np.percentile(s, 95)))
        assert scale_of(s.astype(np.float32)) == pytest.approx(want[repo], rel=1e-5)
    sim = spark.createDataFrame(rows, "repo_id string, i int, j int, s double")
    n = spark.createDataFrame([("many", 25), ("few", 12), ("ties", 14), ("none", 11), ("tiny", 4)], "repo_id string, n int")
    for buckets in (1000, 7, 1):
        assert {x.repo_id: x.scale for x in combine.boost_scale(sim, n, buckets=buckets).collect()} == pytest.approx(want)


def test_matrix_from_lists():
    r = np.random.RandomState(1)
    n, lists = 150, []
    for size in (2, 3, 60, 90, 140):
        docs = np.sort(r.choice(n, size, replace=False))
        lists.append((docs, r.rand(size)))
    want = np.zeros((n, n))
    for docs, w in lists:
        want[np.ix_(docs, docs)] += w
    assert np.allclose(similarities(n, lists), want, atol=1e-5)
    assert np.allclose(step_scores(n, lists, [0, 5, 9], [1, 7, 9]), [want[0, 1], want[5, 7], want[9, 9]])


def test_connections_equal_the_tables(spark):
    e = [("r", "/a", "/b"), ("r", "/a", "/c"), ("r", "/a", "/a"), ("r", "/gone", "/b"), ("r", "/gone", "/d"), ("r", "/d", "/b"), ("r", "/a", "/lost")]
    edges = spark.createDataFrame([(*x, 1.0, "Python" if x[1] != "/d" else "Other") for x in e], "repo_id string, from_file string, to_file string, weight double, language string")
    files = spark.createDataFrame([("r", p, k) for k, p in enumerate(("/a", "/b", "/c", "/d"))], "repo_id string, path string, idx int")
    table = {x.i * 4 + x.j: x.g for x in imports.indexed(imports.augmented(edges), files).collect()}
    hubs = [(x["at"], np.array(x.to), np.array(x.weights), np.array(x.back)) for x in imports.hubs(edges, files).collect()]
    assert {k: v for k, v in connections(4, hubs).items() if v} == pytest.approx(table)
