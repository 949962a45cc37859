"""Every statement of this subpackage gives its query's rows, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tesserae.llm import oracles, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(frame):
    cols = sorted(frame.columns)
    plain = lambda v: None if v is pd.NA or v is None or v != v else float(v) if type(v).__name__.startswith(("float", "int")) else v
    return cols, sorted(repr([plain(v) for v in row]) for row in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_statement(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows_of(queries.queries()[name](spark, DATA).toPandas()) == rows_of(con.execute(oracles.oracle_sql()[name]).df())
