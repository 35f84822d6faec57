"""Retrieval: BM25, phrases, cosine, fusion, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.functions.text import FOLD_FROM, FOLD_TO, TOKEN, token_estimate
from webskein.operators import context, fusion, lexical, semantic
from webskein.plans.staging import shared, stage

TERMS = {"q1": "license Public", "q2": "stupid idiot clown", "q3": "der und die", "q4": "que los token", "q5": "Zzyzx ???"}
PHRASES = {"p1": "General-Public", "p2": "All.rights reserved", "p3": "example.com"}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


_indexes: dict[tuple, lexical.Index] = {}


def index(spark: SparkSession, d: str) -> lexical.Index:
    """Of whole documents, with source and language as title and heading; built once for a session and folder."""
    key = spark.sparkContext.applicationId, d
    if key not in _indexes:
        _indexes[key] = lexical.build(lexical.tokenised(docs(spark, d), "doc_id", "text", "source", "lang"))
    return _indexes[key]


DIMENSION = 64


def model() -> semantic.HashedWords:
    return semantic.HashedWords(DIMENSION, 1 << 30)


def embedded(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, vector."""
    kind = dict(texts.dtypes)[key]
    out = semantic.embedded(texts.select(F.col(key).alias("chunk_hash"), F.col(text).alias("text")), model)
    return out.select(F.col("chunk_hash").cast(kind).alias("key"), "vector")


def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, (d,), lambda: embedded(docs(spark, d), "doc_id", "text"), "document_vectors")


def vector_ranking(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, key, score of the documents that are nearest by cosine. queries: query_id, query."""
    q = embedded(queries, "query_id", "query").select(F.col("key").alias("query_id"), "vector")
    return semantic.search(document_vectors(spark, d), q, k)


def embedding_sql(rows: str) -> str:
    """HashedWords in SQL: i, v (doubles that went through float32) of the rows' i, t."""
    at = lambda k: f"(strpos('0123456789abcdef', h[{k}]) - 1)"
    return f"""(SELECT i, list_transform(range(0, {DIMENSION}), lambda b: ((coalesce(m[b], 0) / n)::FLOAT)::DOUBLE) AS v FROM (
  SELECT i, map_from_entries(list((b, x))) AS m, sqrt(sum(x * x)) AS n FROM (
    SELECT i, b, CASE WHEN b = 0 AND NOT bool_or(x <> 0) OVER (PARTITION BY i) THEN 1.0 ELSE x END::DOUBLE AS x FROM (
      SELECT i, {at(1)} % 4 * 16 + {at(2)} AS b, sum(1 - 2 * (1 - {at(10)} % 2)) AS x FROM (SELECT i, md5(w) AS h FROM (SELECT i, unnest(list_filter(string_split_regex(lower(coalesce(t, '')), '\\s+'), lambda y: y <> '')) AS w FROM ({rows}))) GROUP BY ALL
      UNION ALL SELECT i, 0, 0 FROM ({rows}) WHERE trim(coalesce(t, '')) = ''))
  GROUP BY i))"""


def queries_frame(spark: SparkSession, q: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(q.items()), "query_id string, query string")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.search(index(spark, d), queries_frame(spark, TERMS), 10)
    return hits.select("query_id", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.search(index(spark, d), queries_frame(spark, PHRASES), 10)
    return hits.select("query_id", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_stats(lexical.tokenised(docs(spark, d), "doc_id", "text", "source", "lang")).select("n_chunks", F.round("avg_tokens", 6).alias("avg_tokens"))


def term_df_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_frequencies(index(spark, d)).orderBy(F.desc("df"), F.desc("cf"), "term").limit(50)


def _toks(col: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({col}, '')), '{FOLD_FROM}', '{FOLD_TO}'), '{TOKEN}')"


INDEX_SQL = f"ix AS (SELECT doc_id, {_toks('text')} AS f0, {_toks('source')} AS f1, {_toks('lang')} AS f2 FROM documents), il AS (SELECT *, len(f0) + len(f1) + len(f2) AS n_tokens FROM ix)"
STATS_SQL = "st AS (SELECT count(*) AS n, avg(n_tokens) AS a FROM il)"


def _values(q: dict[str, str]) -> str:
    """Phrases as SQL rows; literal tokens and their folding are worked out here."""
    import re

    rows = []
    for i, text in q.items():
        seen: list[str] = []
        for lit in re.findall(r"\w+(?:(?:[.+#-]+\w+)|(?:\+\+)|#)*", text):
            if lit.lower() not in seen:
                seen.append(lit.lower())
        for p, lit in enumerate(seen):
            parts = re.findall(r"[^\W_]+", lit)
            rows.append(f"('{i}', {p}, [{', '.join(repr(x) for x in parts)}])")
    return ", ".join(rows)


def _count(f: str) -> str:
    return f"len(list_filter(range(1, len({f}) + 1), lambda i: {f}[i:i + len(ph) - 1] = ph))"


def scores_sql(q: str) -> str:
    """Common table expressions up to ``sc`` (query_id, doc_id, score, tf); q: query that gives query_id, p, ph."""
    return f"""{INDEX_SQL}, {STATS_SQL}, q AS ({q}),
m AS (SELECT query_id, p, doc_id, n_tokens, ({_count("f0")} + 5.0 * {_count("f1")} + 3.0 * {_count("f2")})::DOUBLE AS tf FROM q JOIN il ON list_contains(f0, ph[1]) OR list_contains(f1, ph[1]) OR list_contains(f2, ph[1])),
mm AS (SELECT * FROM m WHERE tf > 0),
df AS (SELECT query_id, p, count(*) AS df FROM mm GROUP BY ALL),
w AS (SELECT query_id, p, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, st),
sc AS (SELECT query_id, doc_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / a))) AS score, sum(tf) AS tf FROM mm JOIN w USING (query_id, p), st GROUP BY ALL)"""


def term_scores_sql(q: str) -> str:
    """The same for single terms, through an equi-join; q: query that gives query_id, p, term."""
    each = " UNION ALL ".join(f"SELECT doc_id, n_tokens, unnest({f}) AS term, {w}::DOUBLE AS w FROM il" for f, w in (("f0", 1), ("f1", 5), ("f2", 3)))
    general = scores_sql("SELECT 1")
    return f"""{INDEX_SQL}, {STATS_SQL}, q AS ({q}), tx AS (SELECT doc_id, n_tokens, term, sum(w) AS tf FROM ({each}) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
mm AS (SELECT query_id, p, doc_id, n_tokens, tf FROM q JOIN tx USING (term)),
{general[general.index("df AS (SELECT query_id"):]}"""


def _topk(q: dict[str, str]) -> str:
    return f"""WITH {scores_sql(f"SELECT * FROM (VALUES {_values(q)}) v(query_id, p, ph)")},
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM sc)
SELECT * FROM r WHERE rank <= 10"""


# vectors


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    q = v.where(F.col("key") % 100 == 0).select(F.col("key").alias("query_id"), "vector")
    return semantic.search(v, q, 5).select("query_id", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


COSINE_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, greatest(-1.0, least(1.0, list_sum(list_transform(list_zip(e.v, q.v), lambda p: p[1] * p[2])))) AS score FROM e, e q WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INT AS rank, vec_id, round(score, 6) AS score FROM s)
SELECT * FROM r WHERE rank <= 5"""


def store_of_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as chunks, and the embeddings as vectors of two models: ids beyond the documents' are stale."""
    chunks = docs(spark, d).select(F.col("doc_id").alias("chunk_hash"))
    v = vectors(spark, d).select((F.col("key") * 3).alias("chunk_hash"), "vector", F.when(F.col("key") % 5 == 0, "m2").otherwise("m1").alias("model_fingerprint"))
    return chunks, v


def embedding_readiness(spark: SparkSession, d: str) -> DataFrame:
    return semantic.readiness(*store_of_vectors(spark, d), "m1")


def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return semantic.missing(*store_of_vectors(spark, d), "m1").select(F.col("chunk_hash").alias("doc_id"))


def stale_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return semantic.stale(*store_of_vectors(spark, d), "m1", 64).select(F.col("chunk_hash").alias("chunk_id"))


def vector_problems(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 10 == 4, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding")).alias("vector"))
    return semantic.validated(v, 64).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


STORE_SQL = "WITH c AS (SELECT doc_id AS h FROM documents), v AS (SELECT vec_id * 3 AS h, CASE WHEN vec_id % 5 = 0 THEN 'm2' ELSE 'm1' END AS m FROM embeddings)"


# fusion and context


def two_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best by BM25, and by vectors."""
    q = queries_frame(spark, TERMS)
    lists = {"bm25": (lexical.search(index(spark, d), q, 20), 1.0), "semantic": (vector_ranking(spark, d, q, 20), 0.5)}
    each = [r.select("query_id", F.lit(s).alias("strategy"), F.lit(w).alias("weight"), "key", "rank", F.col("score").alias("raw_score")) for s, (r, w) in lists.items()]
    return stage(each[0].union(each[1]), "rankings")


def vectors_sql(queries: str) -> str:
    """Common table expressions up to ``vs`` (query_id, doc_id, score); queries: query that gives i, t."""
    dot = "list_sum(list_transform(list_zip(d.v, q.v), lambda p: p[1] * p[2]))"
    return f"""vd AS MATERIALIZED {embedding_sql("SELECT doc_id AS i, text AS t FROM documents")}, vq AS MATERIALIZED {embedding_sql(queries)},
vs AS (SELECT q.i AS query_id, d.i AS doc_id, greatest(-1.0, least(1.0, {dot})) AS score FROM vd d, vq q)"""


_TEXTS = f"SELECT * FROM (VALUES {', '.join(f'({i!r}, {t!r})' for i, t in TERMS.items())}) v(i, t)"
RANKINGS_SQL = f"""{term_scores_sql(f"SELECT query_id, p, ph[1] AS term FROM (VALUES {_values(TERMS)}) v(query_id, p, ph)")},
ra AS (SELECT query_id, 'bm25' AS strategy, 1.0 AS weight, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS rank FROM sc),
{vectors_sql(_TEXTS)},
rb AS (SELECT query_id, 'semantic' AS strategy, 0.5 AS weight, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vs),
rk AS (SELECT * FROM ra WHERE rank <= 20 UNION ALL SELECT * FROM rb WHERE rank <= 20),
fu AS (SELECT query_id, doc_id, sum(weight / (60 + rank)) AS score, count(*) AS n_lists, min(rank) AS best, min(rank) FILTER (WHERE strategy = 'bm25') AS bm25_rank, min(rank) FILTER (WHERE strategy = 'semantic') AS semantic_rank FROM rk GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, n_lists DESC, best, bm25_rank NULLS LAST, semantic_rank NULLS LAST, doc_id)::INT AS rank FROM fu)"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(two_rankings(spark, d), limit=10)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).select("query_id", "rank", F.col("key").alias("doc_id"), F.round("score", 9).alias("score"), "n_lists", "bm25_rank", "semantic_rank")


def rrf_evidence(spark: SparkSession, d: str) -> DataFrame:
    return fusion.evidence(fusion.fuse(two_rankings(spark, d), limit=40))


def ranking_problems(spark: SparkSession, d: str) -> DataFrame:
    r = two_rankings(spark, d)
    return fusion.problems(r.withColumn("rank", F.when((F.col("query_id") == "q1") & (F.col("rank") > 3), F.col("rank") + 1).otherwise(F.col("rank"))))


BUDGET = 900


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    size = docs(spark, d).select(F.col("doc_id").alias("key"), token_estimate(F.col("text")).alias("n_tokens"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    hits = fused(spark, d).join(size, "key").select("query_id", "rank", "content_hash", F.col("key").alias("document_id"), "n_tokens", F.col("n_tokens").alias("source_tokens"))
    out = context.select_context(hits, BUDGET)
    return out.select("query_id", "candidates", "n_selected", "used_tokens", F.round("reduction", 6).alias("reduction"), F.array_join(F.transform("selected", lambda s: s["rank"].cast("string")), ",").alias("ranks"))


CONTEXT_SQL = f"""WITH RECURSIVE {RANKINGS_SQL},
hi AS (SELECT f.query_id, f.rank, f.doc_id, (length(text) + 3) // 4 AS n, sha256(text) AS h FROM fr f JOIN documents USING (doc_id) WHERE rank <= 10),
de AS (SELECT query_id, h, min(rank) AS rank, arg_min(n, rank) AS n, arg_min(doc_id, rank) AS doc_id FROM hi GROUP BY query_id, h),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM de),
f(query_id, i, used, ranks, k) AS (
  SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, '', 0::BIGINT FROM o
  UNION ALL SELECT f.query_id, o.i, CASE WHEN used + n <= {BUDGET} THEN used + n ELSE used END, CASE WHEN used + n <= {BUDGET} THEN (CASE WHEN ranks = '' THEN '' ELSE ranks || ',' END) || rank ELSE ranks END, CASE WHEN used + n <= {BUDGET} THEN k + 1 ELSE k END
  FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1)
SELECT l.query_id, (SELECT count(*) FROM hi WHERE hi.query_id = l.query_id) AS candidates, k AS n_selected, used AS used_tokens,
       round(greatest(0, least(1, 1 - used / (SELECT sum(n) FROM de WHERE de.query_id = l.query_id))), 6) AS reduction, ranks FROM l"""

QUERIES = {
    "bm25_topk": bm25_topk, "bm25_phrase": bm25_phrase, "corpus_stats": corpus_stats, "term_df_topk": term_df_topk, "cosine_topk": cosine_topk, "embedding_readiness": embedding_readiness,
    "missing_embeddings": missing_embeddings, "stale_embeddings": stale_embeddings, "vector_problems": vector_problems, "rrf_fusion": rrf_fusion, "rrf_evidence": rrf_evidence, "ranking_problems": ranking_problems, "context_budget": context_budget,
}
ORACLES = {
    "bm25_topk": _topk(TERMS),
    "bm25_phrase": _topk(PHRASES),
    "corpus_stats": f"WITH {INDEX_SQL}, {STATS_SQL} SELECT n AS n_chunks, round(a, 6) AS avg_tokens FROM st",
    "term_df_topk": f"WITH {INDEX_SQL}, e AS (SELECT doc_id, unnest(list_concat(list_concat(f0, f1), f2)) AS term FROM il) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM e GROUP BY term ORDER BY df DESC, cf DESC, term LIMIT 50",
    "cosine_topk": COSINE_SQL,
    "embedding_readiness": STORE_SQL + """, x AS (SELECT count(*) AS n_chunks, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v WHERE v.h = c.h AND m = 'm1')) AS n_vectors FROM c)
SELECT n_chunks, n_vectors, n_chunks - n_vectors AS n_missing, (SELECT count(*) FROM v WHERE m = 'm1' AND h NOT IN (SELECT h FROM c)) AS n_stale, 256 * (SELECT count(*) FROM v WHERE m = 'm1') AS stored_bytes, (SELECT count(*) FROM v WHERE m = 'm2') AS n_other, n_chunks > 0 AND n_chunks = n_vectors AS ready FROM x""",
    "missing_embeddings": STORE_SQL + " SELECT h AS doc_id FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.h = c.h AND m = 'm1')",
    "stale_embeddings": STORE_SQL + " SELECT h AS chunk_id FROM v WHERE m = 'm1' AND NOT EXISTS (SELECT 1 FROM c WHERE c.h = v.h)",
    "vector_problems": "SELECT CASE WHEN vec_id % 10 = 3 THEN 'dimension' WHEN vec_id % 10 = 4 THEN 'not normalised' ELSE 'none' END AS problem, count(*) AS n FROM embeddings GROUP BY 1",
    "rrf_fusion": f"WITH {RANKINGS_SQL} SELECT query_id, rank, doc_id, round(score, 9) AS score, n_lists, bm25_rank::INT AS bm25_rank, semantic_rank::INT AS semantic_rank FROM fr WHERE rank <= 10",
    "rrf_evidence": f"WITH {RANKINGS_SQL} SELECT query_id, count(*) AS candidates, count(*) FILTER (WHERE n_lists = 2) AS overlap, count(*) FILTER (WHERE semantic_rank IS NULL) AS bm25_only, count(*) FILTER (WHERE bm25_rank IS NULL) AS semantic_only FROM fr WHERE rank <= 40 GROUP BY query_id",
    "ranking_problems": f"WITH {RANKINGS_SQL} SELECT query_id, strategy, 'ranks' AS problem FROM rk WHERE query_id = 'q1' GROUP BY query_id, strategy HAVING count(*) > 3",
    "context_budget": CONTEXT_SQL,
}
