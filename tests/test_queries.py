"""Every registered core query against its SQL, on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from factloom import queries as own

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
own.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = own.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in own.ORACLE_SQL:
        assert columns
        return
    c = con.execute(own.ORACLE_SQL[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(k)]) for k in columns) for r in c.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-4)), (name, a, b)
