"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from beamline import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, list):
        return tuple(plain(x) for x in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir), duck.execute(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda frame: Counter(tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False))
    a, b = rows(got.toPandas()), rows(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    assert sum(a.values()) > 0
