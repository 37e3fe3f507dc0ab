"""Every query with an oracle against DuckDB on the same tables."""

import glob
import math

import duckdb
import pytest

from silsila import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        if isinstance(x, bool) or x is None:
            return str(x)
        return f"{float(x):.9g}" if isinstance(x, int) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(value(r[k]) for k in at) for r in rows), [columns[k] for k in at]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    relation = duck.sql(registry.oracle_sql()[name])
    want = canonical(relation.fetchall(), relation.columns)
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0])
    assert got[0] == want[0]


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())
