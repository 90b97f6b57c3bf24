"""Every registered query with an oracle equals DuckDB at sf0.001."""
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from cohortkit.plans import load_all

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# The queries of the library itself; those of its text operators are compared in their own folder.
SQL = {name: e.sql for name, e in load_all().items() if e.sql is not None}
TYPE_PAIRS = {("int", "INTEGER"), ("bigint", "BIGINT"), ("double", "DOUBLE"), ("string", "VARCHAR"),
              ("string", "STRING"), ("boolean", "BOOLEAN")}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        r = round(v, 6)
        return str(int(r)) if r == int(r) else repr(r)
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    # same column types on both sides (the driver's compare includes the schema)
    otypes = {d[0]: str(d[1]).upper() for d in cur.description}
    for c, t in df.dtypes:
        assert (t, otypes[c]) in TYPE_PAIRS, (c, t, otypes[c])
    assert len(srows) == len(orows)
    assert _digest(df.columns, srows) == _digest(ocols, orows)


def test_every_query_registered_has_ops():
    from cohortkit.plans import load_all
    for name, e in load_all().items():
        assert e.ops, name


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["Code", "Gender", "Age"]
