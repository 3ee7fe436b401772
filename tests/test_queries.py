import math

import duckdb
import pytest

from corpuscle.plans import registry

TABLES = "documents embeddings pages benchmark labels conversations events".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def engine(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    return con


def plain(df):
    names = sorted(df.columns)

    def value(x):
        if x is None or x != x or str(x) == "<NA>":
            return None
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return names, sorted((tuple(value(x) for x in r) for r in df[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, engine, sf_small, name):
    got, want = plain(registry.queries()[name](spark, sf_small).toPandas()), plain(engine.sql(SQL[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or math.isclose(float(x), float(y), rel_tol=1e-12)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, sf_small, name):
    rows = registry.queries()[name](spark, sf_small).toPandas()
    assert len(rows.columns) and (len(rows) or name == "aadhaar_numbers")
