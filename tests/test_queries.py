"""Each registered query gives the rows of its SQL."""

import duckdb
import pytest

from rankfield.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def con(small):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    found = con.sql(SQL[name])
    assert sorted(found.columns) == cols
    place = [found.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in found.fetchall()), key=repr)
