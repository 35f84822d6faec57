"""Repeated rows, and searches held against brute force with packs and blocks far smaller than the registered ones."""

import numpy as np
from pyspark.sql import functions as F

from webskein.catalogue import evaluation
from webskein.operators import evaluate, lexical, semantic


def test_document_ids_keep_one_row_where_urls_repeat(spark):
    known = spark.createDataFrame([("b", "u"), ("a", "u"), ("c", "v")], "document_id string, url string")
    got = spark.createDataFrame([(1, "u", "v", "raw1"), (2, "w", "u", "raw2"), (3, "w", "w", "raw3")], "n int, canonical_url string, url string, document_id string")
    assert sorted((r.n, r.document_id) for r in evaluate.document_ids(got, known).collect()) == [(1, "a"), (2, "a"), (3, "raw3")]


def test_mapped_ids_of_pages_that_repeat_a_url(spark, tmp_path):
    spark.createDataFrame([(i, "http://h/") for i in range(6)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id, r.document_id) for r in evaluation.mapped_ids(spark, str(tmp_path)).collect())
    assert got == [(i, f"raw{i}" if i % 3 == 2 else f"d{i}") for i in range(6)]


def test_search_in_packs_equals_all_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i % 90:02}x{i}", " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) if x < 50), "w1 w2" if i % 7 == 0 else None) for i in range(150)]
    index = lexical.build(lexical.tokenised(spark.createDataFrame(rows, "id string, a string, b string"), "id", "a", "b"))
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w3-w1 w9"), (3, "w1 W1 w-1"), (4, "nowhere"), (5, "w40 w30 w20 w10")], "query_id int, query string")
    asked = lexical.parsed(queries)
    all_ = lexical.top(lexical.bm25(index, asked), 7, F.round("score", 9), F.col("key"))
    want = sorted((r.query_id, r.rank, r.key, r.score) for r in all_.collect())
    some = lexical.best(index, asked, 7, pack=100, block=2)
    assert sorted((r.query_id, r.rank, r.key, r.score) for r in lexical.top(some, 7, F.round("score", 9), F.col("key")).collect()) == want
    assert sorted((r.query_id, r.rank, r.key, r.score) for r in lexical.search(index, queries, 7).collect()) == want
    assert some.groupBy("query_id").count().agg(F.max("count")).first()[0] < lexical.bm25(index, asked).groupBy("query_id").count().agg(F.max("count")).first()[0]


def test_postings_keep_places_and_fields(spark):
    index = lexical.build(lexical.tokenised(spark.createDataFrame([(1, "b a b", "a"), (2, None, None), (3, "a", "b b")], "id long, t string, h string"), "id", "t", "h"))
    field = 1 << lexical.FIELD_BITS
    got = {(r.key, r.term): (r.n_tokens, r.tf, r["at"]) for r in index.postings.collect()}
    assert got == {(1, "a"): (4, 6.0, [1, field]), (1, "b"): (4, 2.0, [0, 2]), (3, "a"): (3, 1.0, [0]), (3, "b"): (3, 10.0, [field, field + 1])}
    assert {(r.term, r.df, r.cf) for r in index.terms.collect()} == {("a", 2, 3), ("b", 2, 4)}


def test_vector_search_holds_few_scores_at_once(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (200, 4)).astype(float)
    x[~x.any(1), 0] = 1
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<double>")
    want = []
    for q in range(0, 200, 10):
        s = sorted(range(200), key=lambda i: (-round(float(np.clip(x[q] @ x[i], -1, 1)), 9), i))
        want += [(q, r + 1, i) for r, i in enumerate(s[:9])]
    got = semantic.search(df, df.where("key % 10 = 0").select(F.col("key").alias("query_id"), "vector"), 9, block=8, pack=60, cells=64)
    assert sorted((r.query_id, r.rank, r.key) for r in got.collect()) == sorted(want)
    parts = lexical.first_k(np.array([1.0, float("nan"), 2.0, 1.0]), 3)
    assert parts.tolist() == [2, 0, 3]


def test_words_are_hashed_once_and_forgotten(monkeypatch):
    provider = semantic.HashedWords(8)
    two = provider.embed(["a b a", "c"])
    monkeypatch.setattr(semantic, "WORDS", 0)
    assert provider.embed(["a b a", "c"]) == two and set(provider.places) == {"c"}
