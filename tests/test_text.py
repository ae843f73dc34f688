from collections import Counter

from pyspark.sql import functions as F

from shelfmark.functions import text as X

BAGS = {
    "getPropertyName": "getPropertyName get get Property Name PropertyName getpropertyname property name propertyname",
    "getPropertyNam": "getPropertyNam get get Property Nam PropertyNam getpropertynam property nam propertynam",
    "get_property_name": "get_property_name get_property_name get get property property name name propertyname propertyname",
    "_private": "_private _private private private private private",
    "thi": "thi thi",
}
STEMS = {"queries": "query", "files": "fil", "classes": "classes", "class": "class", "buses": "buses", "xaies": "xaies", "s": "", "es": "", "CLASSES": "CLASSES", "getPropertyNames": "getPropertyNam", "this": "thi"}
CAMEL = {"HTTPServerError": ["HTTP", "Server", "Error"], "ABcDe": ["A", "Bc", "De"], "aB": ["a", "B"], "iPhone": ["i", "Phone"], "_Foo": ["_", "Foo"], "plain": [], "UPPER": []}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", X.singular(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == STEMS


def test_camel_split(spark):
    df = spark.createDataFrame([(w,) for w in CAMEL], "w string").select("w", X.camel_pieces(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == CAMEL


def test_bags_of_the_fixtures(spark):
    df = spark.createDataFrame([(w,) for w in BAGS], "w string").select("w", X.terms(X.bag(F.col("w"))).alias("t"))
    assert {r.w: Counter(r.t) for r in df.collect()} == {w: Counter(t.split()) for w, t in BAGS.items()}


def test_identifiers_trail_digits_only(spark):
    df = spark.createDataFrame([("foo1bar2 x9y 中文 \U0001f600ok", None)], "a string, b string")
    r = df.select(X.identifiers(F.col("a")).alias("a"), X.identifiers(F.col("b")).alias("b")).first()
    assert r.a == ["foo1", "bar2", "x9", "y", "中文", "ok"] and r.b is None


def test_analyzer_is_case_sensitive_and_null_safe(spark):
    df = spark.createDataFrame([("Python",), ("python",), ("Markdown",), ("Rust",), (None,)], "language string")
    assert [r[0] for r in df.select(X.analyzer()).collect()] == ["Python", "default", "Text", "default", "default"]


def test_ngrams_and_accents(spark):
    df = spark.createDataFrame([("a b c", "Éàß"), ("", None)], "a string, b string")
    r = df.select(X.ngrams(F.split("a", " "), 1, 2).alias("n"), X.char_ngrams(F.col("a"), 3, 3).alias("c"), X.strip_accents(F.col("b")).alias("s")).collect()
    assert r[0].n == ["a", "b", "c", "a b", "b c"] and r[0].c == ["a b", " b ", "b c"] and r[0].s == "Eaß"
    assert r[1].n == [""] and r[1].c == [] and r[1].s is None
