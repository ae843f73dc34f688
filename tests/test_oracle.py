"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import pytest

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
    return sorted(map(str, df.astype(object).where(df.notna(), None).astype(str).values.tolist()))


def names():
    from shelfmark import queries

    return sorted(queries.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in names() if n in ("presort", "identifiers", "plural_stem", "camel_split", "snake_split", "keyword_bag", "vocab_prune", "norm_l2", "pair_similarity", "boost_scale", "augmented_edges", "graph_matrix", "name_transit", "connection_metrics", "max_features", "failure_conditions")])
def test_query(spark, duck, name):
    from shelfmark import queries

    assert rows(queries.queries()[name](spark, D).toPandas()) == rows(duck.execute(queries.oracle_sql()[name]).df())


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
