import datetime as dt

from shelfmark.streaming.reorder import start

SCHEMA = "file_id long, repo_id string, path string, language string, content string, ingested_at timestamp"


def row(i, repo, path, text, day):
    return (i, repo, path, "Go", text, dt.datetime(2024, 1, day))


def test_only_changed_repositories_are_ordered_again(spark, tmp_path):
    stored = spark.createDataFrame([row(1, "a", "/x.go", "alpha", 1), row(2, "a", "/y.go", "beta", 1), row(3, "b", "/z.go", "gamma", 1)], SCHEMA)
    spark.createDataFrame([row(4, "a", "x.go", "delta", 2)], SCHEMA).write.parquet(str(tmp_path / "in"))
    got = []
    empty = spark.createDataFrame([], "language string, word string")
    start(spark, str(tmp_path / "in"), lambda: stored, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"), stopwords=empty).awaitTermination()
    assert {(r.repo_id, r.path, r.content) for r in got} == {("a", "/x.go", "delta"), ("a", "/y.go", "beta")}
    assert {r.status for r in got} == {"pair"}
