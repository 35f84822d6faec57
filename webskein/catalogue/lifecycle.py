"""The life of an embedding table, ranking checks, provenance updates and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.catalogue.indexing import LINES_SQL, bridge, documents_of
from webskein.catalogue.retrieval import RANKINGS_SQL, STORE_SQL, TERMS, docs, queries_frame, store_of_vectors, two_rankings, vector_ranking, vectors
from webskein.functions import text
from webskein.operators import fusion, semantic, store


def embedding_plan(spark: SparkSession, d: str) -> DataFrame:
    return semantic.plan(*store_of_vectors(spark, d), "m1", 64)


def new_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for every second document id; each seventh is cut short, and each eleventh isn't of unit length."""
    i = F.col("key")
    v = F.when(i % 7 == 0, F.slice("vector", 1, 60)).when(i % 11 == 0, F.transform("vector", lambda x: x * 3)).otherwise(F.col("vector"))
    return vectors(spark, d).select((i * 2).alias("chunk_hash"), v.alias("vector"))


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of two models after one model's new ones are stored."""
    chunks, old = store_of_vectors(spark, d)
    out = semantic.stored(old, new_vectors(spark, d), chunks, "m1", 64)
    return out.select("chunk_hash", "model_fingerprint", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


def vector_rejects(spark: SparkSession, d: str) -> DataFrame:
    return semantic.rejected(new_vectors(spark, d), store_of_vectors(spark, d)[0], 64)


def pending_invalidations(spark: SparkSession, d: str) -> DataFrame:
    models = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "model_fingerprint string")
    chunks, v = store_of_vectors(spark, d)
    return semantic.pending(models, v, chunks)


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    t = semantic.document_text(F.col("source"), F.array("lang", "source"), F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(t.cast("binary")).alias("text_md5"))


def query_texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", semantic.query_text(F.concat(F.lit(" \n"), "text", F.lit("\t "))).alias("query"))


def input_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Of documents in batches by source, with inputs of more than 400 words cut off."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    batches = docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(n > 400).alias("truncated"), F.max(n).alias("longest"), F.avg(n).alias("mean"))
    return semantic.input_statistics(batches).withColumn("mean", F.round("mean", 6))


def hybrid_readiness(spark: SparkSession, d: str) -> DataFrame:
    chunks, v = store_of_vectors(spark, d)
    return fusion.readiness(chunks.agg(F.count("*").alias("n_chunks")), semantic.readiness(chunks, v, "m1"))


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = vector_ranking(spark, d, queries_frame(spark, TERMS), 10)
    return hits.select("query_id", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def told(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings whose lists tell different titles of each fifth document."""
    return two_rankings(spark, d).withColumn("title", F.when((F.col("strategy") == "bm25") & (F.col("key") % 5 == 0), "b").otherwise("a"))


def fusion_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return fusion.disagreements(told(spark, d), "title").select("query_id", F.col("key").alias("doc_id"))


def fusion_representatives(spark: SparkSession, d: str) -> DataFrame:
    return fusion.representatives(told(spark, d), "title").select("query_id", F.col("key").alias("doc_id"), "title", "from_strategy")


def provenance_after_update(spark: SparkSession, d: str) -> DataFrame:
    """Provenance after every third document is gone, worked out from that before."""
    documents, links = documents_of(spark, d), bridge(spark, d).select("content_hash", "ordinal", "chunk_hash").distinct()
    gone = F.col("document_id") % 3 == 0
    return store.provenance_update(store.provenance(links, documents), links, documents.where(~gone), documents.where(gone))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("user_id").alias("session")).agg(F.min("event_id").alias("started_at"), F.max("event_id").alias("finished_at"), F.count("*").alias("documents"))


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return store.sessions_summary(_sessions(spark, d))


def session_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as an indexing session's batches."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session"), F.lit(1).alias("documents"), (F.col("event_id") % 7).alias("chunks"), F.array("event_type").alias("failure_categories"))
    return store.merged(e).withColumn("failure_categories", F.array_join("failure_categories", ","))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Code lines, fence sizes and table cells of pages' html."""
    h = F.regexp_replace("html", ">", "> | ``` \r\n")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(text.code_lines(h).cast("binary")).alias("code_md5"), text.longest_run(h, "`").alias("run"), F.md5(text.table_cell(h).cast("binary")).alias("cell_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        embedding_plan, vector_upsert, vector_rejects, pending_invalidations, embedding_texts, query_texts, input_statistics, hybrid_readiness, semantic_topk, fusion_disagreements, fusion_representatives, provenance_after_update, session_summary,
        session_totals, text_forms,
    )
}
_NEW = STORE_SQL + ", nv AS (SELECT vec_id * 2 AS h, vec_id, embedding[1] AS first FROM embeddings), good AS (SELECT * FROM nv WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND h IN (SELECT h FROM c))"
_TOLD = f"{RANKINGS_SQL}, tl AS (SELECT *, CASE WHEN strategy = 'bm25' AND doc_id % 5 = 0 THEN 'b' ELSE 'a' END AS title FROM rk)"
_WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"
_H = "replace(html, '>', '> | ``` ' || chr(13) || chr(10))"
ORACLES = {
    "embedding_plan": STORE_SQL + """ SELECT count(*) AS considered, count(*) FILTER (WHERE h IN (SELECT h FROM v WHERE m = 'm1')) AS cache_hits, count(*) FILTER (WHERE h NOT IN (SELECT h FROM v WHERE m = 'm1')) AS to_embed,
(SELECT count(*) FROM v WHERE m = 'm1' AND h NOT IN (SELECT h FROM c)) AS to_purge FROM c""",
    "vector_upsert": f"""WITH {_NEW[5:]}, o AS (SELECT vec_id * 3 AS h, CASE WHEN vec_id % 5 = 0 THEN 'm2' ELSE 'm1' END AS m, embedding[1] AS first FROM embeddings)
SELECT h AS chunk_hash, m AS model_fingerprint, round(first::DOUBLE, 6) AS first FROM o WHERE m = 'm2' OR (h IN (SELECT h FROM c) AND h NOT IN (SELECT h FROM good)) UNION ALL SELECT h, 'm1', round(first::DOUBLE, 6) FROM good""",
    "vector_rejects": _NEW + " SELECT h AS chunk_hash, CASE WHEN h NOT IN (SELECT h FROM c) THEN 'unknown chunk' WHEN vec_id % 7 = 0 THEN 'dimension' ELSE 'not normalised' END AS reason FROM nv WHERE h NOT IN (SELECT h FROM good)",
    "pending_invalidations": STORE_SQL + " SELECT k AS model_fingerprint, (SELECT count(*) FROM v WHERE v.m = k AND h NOT IN (SELECT h FROM c)) AS pending_invalidations FROM (VALUES ('m1'), ('m2'), ('m3')) t(k)",
    "embedding_texts": "SELECT doc_id, md5('Title: ' || source || chr(10) || 'Section: ' || lang || ' > ' || source || chr(10) || chr(10) || text) AS text_md5 FROM documents",
    "query_texts": r"SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS query FROM benchmark",
    "input_statistics": f"SELECT count(*) AS n, count(*) FILTER (WHERE {_WORDS} > 400) AS truncated, max({_WORDS})::INT AS longest, round(avg({_WORDS}), 6) AS mean FROM documents",
    "hybrid_readiness": STORE_SQL + " SELECT count(*) > 0 AS lexical_ready, count(*) > 0 AND bool_and(h IN (SELECT h FROM v WHERE m = 'm1')) AS semantic_ready, count(*) > 0 AND bool_and(h IN (SELECT h FROM v WHERE m = 'm1')) AS ready FROM c",
    "semantic_topk": f"WITH {RANKINGS_SQL}, t AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM vs) SELECT * FROM t WHERE rank <= 10",
    "fusion_disagreements": f"WITH {_TOLD} SELECT query_id, doc_id FROM tl GROUP BY ALL HAVING count(DISTINCT title) > 1",
    "fusion_representatives": f"WITH {_TOLD} SELECT query_id, doc_id, arg_min(title, strategy) AS title, min(strategy) AS from_strategy FROM tl GROUP BY query_id, doc_id",
    "provenance_after_update": f"""WITH {LINES_SQL}, l AS (SELECT DISTINCT content_hash, ordinal, chunk_hash FROM b), r AS (SELECT chunk_hash, canonical_url, d.document_id, ordinal, row_number() OVER (PARTITION BY chunk_hash ORDER BY canonical_url, d.document_id, ordinal) AS k FROM l JOIN dd d USING (content_hash) WHERE d.document_id % 3 <> 0)
SELECT chunk_hash, canonical_url, document_id, ordinal::INT AS ordinal FROM r WHERE k = 1""",
    "session_summary": "WITH s AS (SELECT user_id AS session, min(event_id) AS a, max(event_id) AS z, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS n_sessions, max(z) AS last_finished_at, arg_max(session, (a, session)) AS latest_session, sum(n)::BIGINT AS documents FROM s",
    "session_totals": "SELECT user_id AS session, count(*) AS documents, sum(event_id % 7)::BIGINT AS chunks, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS failure_categories FROM events GROUP BY 1",
    "text_forms": rf"""WITH x AS (SELECT page_id, {_H} AS h FROM pages), y AS (SELECT page_id, h, regexp_replace(regexp_replace(replace(replace(h, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '[ \t]+$', '') AS l FROM x)
SELECT page_id, md5(regexp_replace(regexp_replace(l, '^\n+', ''), '\n+$', '')) AS code_md5, coalesce(list_max(list_transform(regexp_extract_all(h, '`+'), lambda r: length(r))), 0)::INT AS run, md5(replace(h, '|', '\|')) AS cell_md5 FROM y""",
}
