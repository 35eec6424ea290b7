"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillspark.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value) if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([[plain(r[i]) for i in order] for r in rows])


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    cur = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())
