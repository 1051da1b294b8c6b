"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidewright.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(values):
    """Rows without NaN and negative zeros, ordered by all that is no double, then by the doubles as numbers."""
    out = [tuple(None if v is None or v != v else round(v, 9) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in values]
    return sorted(out, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    want = rows(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, want, strict=True)) == 0
