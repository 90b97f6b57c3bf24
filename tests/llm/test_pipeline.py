"""The pipeline stage by stage on sf0.001, and every query once."""
import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import key, lines_kept, link_components, stats

import corpus_pipeline
from cohortkit.llm import load_all

QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def chain(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, fn in corpus_pipeline.STAGES:
        before, docs = docs, fn(spark, docs, sf)
        rows = docs.collect()
        out.append((name, before, docs, rows))
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_stages(chain, spark, sf):
    assert [c[0] for c in chain] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    for _, before, after, _ in chain[:-1]:
        assert after.columns == before.columns and after.schema.simpleString() == before.schema.simpleString()
    (_, docs, _, kept), (_, before, _, lines), (_, b3, _, unique), (_, b4, _, clean), (_, b5, mixed, drawn) = chain
    good = set()
    for r in docs.collect():
        n, _, _, _, rep = stats(r.text)
        if not (n < 10 or 100 * rep > 20 * n):
            good.add(r.doc_id)
    assert {r.doc_id for r in kept} <= good
    rows = before.collect()
    assert key(r.text for r in lines) == key(x[2] for x in lines_kept([r.text for r in rows], 10))
    assert all(r.n_chars == len(r.text) for r in lines)
    want = link_components([(r.doc_id, r.text) for r in b3.collect()])
    assert sorted(r.doc_id for r in unique) == sorted(d for d, n, c in want if d == c)
    items = {" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    left = {r.doc_id for r in clean}
    for r in b4.collect():
        if any(i in " ".join(r.text.lower().split()) for i in items):
            assert r.doc_id not in left
    assert mixed.columns == [*docs.columns, "copy", "shard", "position"]
    assert {r.doc_id for r in drawn} <= left and max(r.copy for r in drawn) <= 1


def test_run(spark, sf, chain):
    assert corpus_pipeline.run(spark, sf).count() == len(chain[-1][3])


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    want = key(cur.fetchall())
    assert key(map(tuple, QUERIES[name](spark, sf).select(*cols).collect())) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_run(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert not any(t == "void" for _, t in df.dtypes)
    assert df.agg(F.count("*")).first()[0] > 0
