"""Every registered query against its SQL on the smallest tables, and plan shapes."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from webskein import catalogue
from webskein.catalogue import retrieval

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = duck.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in r.description]
    want = sorted(tuple(plain(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    p = plan(catalogue.QUERIES["size_stats"](spark, SF))
    assert "ReadSchema: struct<text:string,lang:string>" in p and "BatchEvalPython" not in p
    p = plan(catalogue.QUERIES["cosine_topk"](spark, SF))
    assert "WindowGroupLimit" in p and "ArrowEvalPython" not in p and "NestedLoop" not in p
    ix = retrieval.index(spark, SF)
    terms = spark.createDataFrame([("license",)], "term string")
    p = plan(ix.of(ix.postings, terms))
    assert p.count("PartitionFilters: [isnotnull(bucket") or "PartitionFilters: [bucket" in p or "bucket IN" in p  # a query reads its terms' folders only
    for name in catalogue.QUERIES:
        if name.startswith(("strategy", "overlap", "coverage", "judgment", "provenance", "orphan")):
            assert "CartesianProduct" not in plan(catalogue.QUERIES[name](spark, SF)), name
