"""Driver contract: entry smoke, every query runs, and each oracle matches at sf0.01."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry_mod

from conftest import SF_ORACLE, SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha1("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["node", "prediction", "probability", "rules", "coverage", "frequency", "frequency_pct"]
    assert len(rows) >= 1


def test_every_oracle_key_is_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(entry_mod.oracle_sql()))
def test_oracle(spark, duck, key):
    df = entry_mod.queries()[key](spark, SF_ORACLE)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry_mod.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


@pytest.mark.parametrize("key", sorted(set(entry_mod.queries()) - set(entry_mod.oracle_sql())))
def test_rows_only_keys_run(spark, key):
    df = entry_mod.queries()[key](spark, SF_SMALL)
    assert df.count() >= 1
