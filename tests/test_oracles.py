"""Every registered query with an oracle equals its DuckDB SQL at sf0.001."""

import duckdb
import pandas as pd
import pytest

from ivnflow.plans import ORACLES, QUERIES

from conftest import SF001

TABLES = ["orders", "lineitem", "events", "documents", "embeddings", "labels"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def canon(rows):
    def v(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, (list, tuple)) or (hasattr(x, "__len__") and not isinstance(x, (str, bytes))):
            return tuple(x)
        return x
    out = [tuple(v(x) for x in r) for r in rows]
    key = lambda r: tuple((0, float(x), "") if isinstance(x, (int, float)) else (1, 0.0, repr(x)) for x in r)
    return sorted(out, key=key)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF001)
    cols = sorted(sdf.columns)
    s = canon(sdf.select(*cols).toPandas().astype(object).itertuples(index=False, name=None))
    d = con.execute(ORACLES[name]).df()
    assert sorted(d.columns) == cols
    d = canon(d[cols].astype(object).itertuples(index=False, name=None))
    assert len(s) == len(d)
    assert s == d
