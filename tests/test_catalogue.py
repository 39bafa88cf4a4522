"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from stimframe.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def cells(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    found = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    want = found.select(*[f'"{n}"' for n in names]).fetchall()
    assert cells([tuple(r) for r in df.select(*names).collect()]) == cells(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
