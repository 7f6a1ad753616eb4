"""Every query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF

from vitalgauge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    if name not in catalogue.SQL:
        assert got
        return
    cur = db.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    place = sorted(range(len(names)), key=lambda i: names[i])
    assert got == ordered([tuple(r[i] for i in place) for r in cur.fetchall()])
