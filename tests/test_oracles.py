"""Every query with a statement gives the statement's rows, on the smallest tables."""

import importlib
import os

import duckdb
import pytest

from tesserae import oracles, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(frame):
    cols = sorted(frame.columns)
    plain = lambda v: float(v) if type(v).__name__.startswith(("float", "Decimal")) else int(v) if type(v).__name__.startswith("int") else v
    return cols, sorted(repr([plain(v) for v in row]) for row in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(set(oracles.oracle_sql())))
def test_oracle(spark, duck, name):
    assert rows_of(queries.queries()[name](spark, DATA).toPandas()) == rows_of(duck.execute(oracles.oracle_sql()[name]).df())


def test_every_query_has_an_oracle():
    assert set(queries.queries()) == set(oracles.oracle_sql())


def test_entry_lists_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
