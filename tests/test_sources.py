"""Readers, sinks, positions, samples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.stopwords import by_analyzer, read_lists
from shelfmark.operators import bm25
from shelfmark.plans.ordering import Ordering
from shelfmark.sources.files import flat, keyed, nested, positions, presorted, read_repositories, read_tree, sample, write_result

FILES = "repo_id string, path string, language string, content string"


def test_repositories_nested_and_flat(spark, tmp_path):
    rows = [("r", "/b.py", "Python", "x = 1"), ("r", "/a.py", "Python", None), ("s", "/c.go", "Go", "")]
    df = spark.createDataFrame(rows, FILES)
    df.write.parquet(str(tmp_path / "flat"))
    nested(df).write.json(str(tmp_path / "json"))
    nested(df).write.orc(str(tmp_path / "orc"))
    for folder, format in (("flat", "parquet"), ("json", "json"), ("orc", "orc")):
        got = read_repositories(spark, str(tmp_path / folder), format).select("repo_id", "path", "language", "content")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_tree_and_decode_errors(spark, tmp_path):
    (tmp_path / "r" / "sub").mkdir(parents=True)
    (tmp_path / "r" / "sub" / "a.py").write_text("é = 1\n", encoding="utf-8")
    (tmp_path / "r" / "b.txt").write_bytes(b"bad \xff end")
    languages = {"py": "Python"}
    read = lambda mode: {r.path: r for r in read_tree(spark, str(tmp_path), languages, decode_error=mode).collect()}
    got = read("replace")
    assert {(r.repo_id, r.path, r.language) for r in got.values()} == {("r", "/sub/a.py", "Python"), ("r", "/b.txt", None)}
    assert got["/sub/a.py"].content == "é = 1\n" and got["/b.txt"].content == "bad � end"
    assert read("null")["/b.txt"].content is None
    with pytest.raises(Exception, match="(?i)utf8"):
        read("strict")
    with pytest.raises(ValueError):
        read_tree(spark, str(tmp_path), decode_error="maybe")


def test_stop_lists_from_files(spark, tmp_path):
    (tmp_path / "Text.txt").write_text(" the \n\nand\nthe\n")
    (tmp_path / "default.txt").write_text("new\n")
    lists = read_lists(spark, str(tmp_path))
    assert {tuple(r) for r in lists.collect()} == {("Text", "the"), ("Text", "and"), ("default", "new")}
    assert {r.word for r in by_analyzer(lists).where("analyzer = 'JSON'").collect()} == {"the", "and", "new"}


def test_positions_against_sorting(spark):
    r = random.Random(4)
    rows = [(r.choice("aab"), f"/{r.randrange(40)}", k) for k in range(500)] + [(None, "/x", 900), (None, "/w", 901)]
    df = spark.createDataFrame(rows, "g string, p string, k long").repartition(7)
    got = {x.k: (x.idx, x.n_files) for x in positions(df, ["g"], ["p", "k"]).collect()}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: x[1:])
        assert [got[x[2]] for x in own] == [(n, len(own)) for n in range(len(own))]


def test_repeated_rows_keep_their_places(spark):
    rows = [("r", "a", None, "x"), ("r", "/a", None, "x"), ("r", "/a", None, None), ("r", "/b", None, "x")] * 2
    got = presorted(spark.createDataFrame(rows, FILES))
    assert sorted(x.idx for x in got.collect()) == list(range(8)) and got.columns == [*FILES.replace(" string", "").split(", "), "idx", "n_files"]


def exchanges(df):
    """(columns that are sent, how) of every exchange of the plan."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    for block in re.split(r"\n\n", plan):
        if re.match(r"\(\d+\) Exchange", block.strip()):
            yield re.findall(r"(\w+)#", block.split("Input", 1)[1].split("\n")[0]), block.split("Arguments: ")[1]


def test_contents_never_meet_by_repository(spark):
    """Contents cross a shuffle by row only, so no task gets a repository's texts."""
    df = spark.range(50).select(F.col("id").alias("file_id"), F.lit("r").alias("repo_id"), F.concat(F.lit("/"), "id").alias("path"), F.lit("Go").alias("language"), F.concat(F.lit("alpha "), "id").alias("content"))
    p = Ordering(df, spark.createDataFrame([], "language string, word string"))
    assert keyed(df)[1] == ["file_id"]
    for frame in (presorted(df), p.texts("gate"), bm25.counts(p.texts("gate"), p.stopwords), p.result()):
        sent = [how for columns, how in exchanges(frame) if "content" in columns]
        assert sent and all(how.startswith("hashpartitioning(file_id") for how in sent)


def test_sample(spark):
    df = spark.range(100).select("id", F.lit("x").alias("t"))
    got = [x.id for x in sample(df, 250, "id", 3).collect()]
    assert len(got) == 250 and len(set(got)) > 50 and sorted(got) == sorted(x.id for x in sample(df.repartition(5), 250, "id", 3).collect())
    assert sample(df.limit(0), 10, "id").count() == 0


def test_results_are_written(spark, tmp_path):
    rows = [("r", "/main.py", "Python", "from module import helper\n"), ("r", "/module.py", "Python", "def helper(): pass\n"), ("r", "/x.py", "Python", None), ("s", "/a.go", "Go", "x")]
    p = Ordering(spark.createDataFrame(rows, FILES), null_as_empty=True)
    p.write(str(tmp_path / "out"), matching_scores=False, connections=True, connections_score=True)
    files = spark.read.parquet(str(tmp_path / "out" / "files"))
    assert files.count() == 4 and "matching_score" not in files.columns
    assert [(r.from_file, r.to_file) for r in spark.read.parquet(str(tmp_path / "out" / "connections")).collect()] == [("/module.py", "/main.py")]
    scores = {r.repo_id: r for r in spark.read.parquet(str(tmp_path / "out" / "metrics")).collect()}
    assert scores["r"].n_connections == 1 and scores["s"].jaccard is None
    write_result(p.result(), str(tmp_path / "more"), format="json")
    assert "matching_score" in spark.read.json(str(tmp_path / "more")).columns
