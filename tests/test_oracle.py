"""Every query that has SQL, against DuckDB on the smallest tables."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

from pixelmill import queries


def _normal(df: pd.DataFrame) -> list:
    empty = lambda v: v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v)
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        rows.append(tuple("-" if empty(v) else repr(round(float(v), 9)) if isinstance(v, Number) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    ours, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _normal(ours) == _normal(theirs)


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys()
