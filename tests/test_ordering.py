import math

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import bm25, combine, imports, metrics
from shelfmark.plans.ordering import order_files
from shelfmark.sources.files import flat, nested, presorted

FILES = "repo_id string, path string, language string, content string"
NO_STOP = "language string, word string"


def frame(spark, rows, schema=FILES):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def package(spark):
    return frame(spark, [
        ("r", "main.py", "Python", "from module import helper\n"),
        ("r", "/module/__init__.py", "Python", "from .somestuff import helper\n"),
        ("r", "/module/somestuff.py", "Python", "def helper(): pass\n"),
    ])


def test_import_goldens(spark, package):
    f = presorted(package)
    direct = imports.import_edges(f)
    m, i, s = "/main.py", "/module/__init__.py", "/module/somestuff.py"
    assert {(r.from_file, r.to_file) for r in direct.collect()} == {(i, m), (s, i), (s, m)}
    got = {(r.from_file, r.to_file): r.weight for r in imports.augmented(direct).collect()}
    assert got == {(i, m): 1.5, (m, i): 0.75, (s, i): 1.0, (s, m): 1.0, (i, s): 0.25, (m, s): 0.25}


def test_import_corner_cases(spark):
    rows = [
        ("a", "/p/__init__.py", "Python", "from . import x\n"), ("a", "/p/q.py", "Python", "import a.b\nX = 1"),
        ("a", "/u.py", "Python", "from p import q\nimport p.q as z\n"), ("b", "/m.py", "Python", "from mid import *\nfrom mid import deep\n"),
        ("b", "/mid.py", "Python", "from low import *\n"), ("b", "/low.py", "Python", "deep = 1\n"),
        ("c", "/t.py", "Python", "import low\ndef broken(:\n"), ("c", "/low.py", "Python", None), ("c", "/x.go", "Go", "package x"),
    ]
    e = {(r.repo_id, r.from_file, r.to_file) for r in imports.import_edges(presorted(frame(spark, rows))).collect()}
    assert ("a", "/p/__init__.py", "/p/__init__.py") in e  # from . import x
    assert ("a", "/p/__init__.py", "/u.py") in e and ("a", "/p/q.py", "/u.py") in e
    assert ("b", "/low.py", "/m.py") in e  # through the star
    assert ("c", "/low.py", "/t.py") in e  # from the lines that hold imports


def test_registered_analyzers(spark, monkeypatch):
    import re

    from shelfmark.functions import text as X

    monkeypatch.setattr(imports, "ANALYZERS", dict(imports.ANALYZERS))
    for name in ("ANALYZERS", "STOP_LISTS"):
        monkeypatch.setattr(X, name, dict(getattr(X, name)))
    monkeypatch.setattr(X, "ONCE", list(X.ONCE))
    imports.register("Lua", lambda t: [(m, 0, m) for m in re.findall(r'require "(\w+)"', t)], lambda m, level, path: [f"/{m}.lua"])
    rows = [("r", "/a.lua", "Lua", 'require "b"\nrequire "none"'), ("r", "/b.lua", "Lua", "x x x"), ("r", "/c.py", "Python", "import d"), ("r", "/d.py", "Python", "")]
    got = {(r.from_file, r.to_file, r.language) for r in imports.import_edges(presorted(frame(spark, rows))).collect()}
    assert got == {("/b.lua", "/a.lua", "Lua"), ("/d.py", "/c.py", "Python")}
    X.register("Lua", lists=("Text",), once=True)
    words = bm25.raw_words(presorted(frame(spark, rows))).where("analyzer = 'Lua' and word = 'x'").collect()
    assert [w.n for w in words] == [1]


def test_metric_goldens(spark):
    o = spark.createDataFrame([("r", 0, "/s"), ("r", 1, "/i"), ("r", 2, "/m"), ("one", 0, "/x"), ("none", 0, "/a"), ("none", 1, "/b")], "repo_id string, pos int, path string")
    e = spark.createDataFrame([("r", "/i", "/m"), ("r", "/s", "/i"), ("r", "/s", "/m")], "repo_id string, from_file string, to_file string")
    got = {r.repo_id: r for r in metrics.connection_metrics(o, e).collect()}
    assert (got["r"].n_connections, round(got["r"].jaccard, 6), got["r"].recall, got["r"].connection_score) == (3, 0.666667, 1.0, 1.0)
    assert (got["one"].jaccard, got["one"].recall, got["one"].connection_score) == (None, None, None)
    assert (got["none"].jaccard, got["none"].recall, got["none"].connection_score) == (0.0, 0.0, None)


def test_scores_use_the_backward_entry_last(spark):
    o = spark.createDataFrame([("r", 0, 0), ("r", 1, 1), ("r", 2, 2)], "repo_id string, pos int, idx int")
    s = spark.createDataFrame([("r", 0, 1, 5.0), ("r", 1, 2, 4.0), ("r", 2, 1, 1.0)], "repo_id string, i int, j int, s double")
    got = metrics.matching_scores(o, s)
    assert [r.matching_score for r in got.orderBy("pos").collect()] == [5.0, 4.0, 1.0]
    assert metrics.coherence(got).first().coherence_score == 4.0


def test_boost_scale(spark):
    s = spark.createDataFrame([("small", 0, 0, 3.0), ("small", 0, 1, 7.0), ("big", 0, 1, 5.0)], "repo_id string, i int, j int, s double")
    n = spark.createDataFrame([("small", 3), ("big", 10), ("void", 4)], "repo_id string, n int")
    assert {r.repo_id: r.scale for r in combine.boost_scale(s, n).collect()} == {"small": 7.0, "big": 0.01, "void": 0.01}


def test_weights_against_the_formula(spark):
    rows = [("r", 0, "a", 2), ("r", 0, "b", 1), ("r", 1, "a", 1), ("r", 2, "b", 3), ("r", 2, "c", 1)]
    tf = spark.createDataFrame(rows, "repo_id string, idx int, term string, tf long")
    n = spark.createDataFrame([("r", 3)], "repo_id string, n int")
    got = {(r.idx, r.term): r.w for r in bm25.bm25_weights(tf, n, None).collect()}
    keep = [x for x in rows if x[2] != "c"]
    length = {i: sum(x[3] for x in keep if x[1] == i) for i in range(3)}
    for _, i, t, k in keep:
        idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
        assert got[i, t] == pytest.approx(k * 2.2 / (k + 1.2 * (0.25 + 0.75 * length[i] / (sum(length.values()) / 3))) * idf)
    assert (2, "c") not in got
    m = bm25.BM25Model(norm=None).fit(tf.where("term <> 'c'"), n).transform(tf.where("term <> 'c'"), n)
    assert {(r.idx, r.term): pytest.approx(r.w) for r in m.collect()} == got


def test_statuses_and_permutations(spark):
    words = ["alpha beta gamma", "beta gamma delta", "gamma delta epsilon", "delta epsilon alpha"]
    rows = [("many", f"f{k}.go", "Go", t) for k, t in enumerate(words)]
    rows += [("two", "a.go", "Go", "x"), ("two", "b.go", "Go", "y"), ("solo", "a.go", "Go", "x")]
    rows += [("holes", "a.go", "Go", None), ("holes", "b.go", "Go", "text"), ("holes", "c.go", "Go", "text")]
    rows += [("mixed", "a.go", "Go", "alpha beta"), ("mixed", "b.go", None, "alpha beta"), ("mixed", "c.go", "Go", "beta"), ("mixed", "d.go", "Go", "gamma")]
    rows += [("same", "a.go", "Go", "alpha"), ("same", "a.go", "Go", "alpha"), ("same", "a.go", "Go", "")]
    df = frame(spark, rows).withColumn("pos", F.lit("own")).withColumn("extra", F.lit(1))
    empty = spark.createDataFrame([], NO_STOP)
    got = order_files(df, empty).collect()
    by = {}
    for r in got:
        by.setdefault(r.repo_id, []).append(r)
    assert {k: {x.status for x in v} for k, v in by.items()} == {
        "many": {"ordered"}, "two": {"pair"}, "solo": {"lexicographic_size"}, "holes": {"ordered_static_only"}, "mixed": {"ordered_content_only"}, "same": {by["same"][0].status}
    }
    for v in by.values():
        assert sorted(x.pos for x in v) == list(range(len(v))) == sorted(x.idx for x in v)
    assert all(x.extra == 1 and isinstance(x.pos, int) for x in got)
    shuffled = order_files(df.repartition(7).orderBy(F.rand(3)), empty).collect()
    assert {(x.repo_id, x.pos, x.path) for x in got} == {(x.repo_id, x.pos, x.path) for x in shuffled}


def test_empty_table(spark):
    empty = spark.createDataFrame([], FILES)
    assert order_files(empty, spark.createDataFrame([], NO_STOP)).count() == 0


def test_nested_round_trip(spark, package):
    assert sorted(map(tuple, flat(nested(package)).select("repo_id", "path", "language", "content").collect())) == sorted(map(tuple, package.collect()))


def test_missing_column(spark):
    with pytest.raises(ValueError, match="language"):
        flat(spark.createDataFrame([("r", "p", "c")], "repo_id string, path string, content string"))
