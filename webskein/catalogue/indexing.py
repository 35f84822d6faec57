"""Cleaning, chunking, deduplication, provenance and store maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.catalogue.retrieval import docs
from webskein.functions.text import digest, evidence, overlap_suffix, sentences, slices, token_estimate, utf8_size
from webskein.operators import chunk, html, store


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def size_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length(t)).alias("chars"), F.sum(utf8_size(t)).alias("bytes"), F.sum(token_estimate(t)).alias("tokens"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", F.md5(F.col("s").cast("binary")).alias("sentence_md5"))


def hard_slices(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(slices(F.col("text"), 500)).alias("pos", "s")).select("doc_id", "pos", F.length("s").alias("n"), F.md5(F.col("s").cast("binary")).alias("slice_md5"))


def overlap_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", overlap_suffix(F.col("text"), 160).alias("suffix"))


def evidence_form(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(evidence(F.col("text")).cast("binary")).alias("evidence_md5"))


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document as a paragraph; lines that begin a licence notice head what follows."""
    each = docs(spark, d).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return each.select("document_id", "pos", F.lit("paragraph").alias("kind"), "text", F.array().cast("array<string>").alias("heading_path"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    about = docs(spark, d).select(F.col("doc_id").alias("document_id"), F.concat(F.lit("https://corpus/"), "doc_id").alias("source_url"), F.col("source").alias("title"))
    c = chunk.chunks(line_blocks(spark, d), about, chunk.ChunkConfig(overlap=0))
    return c.select(F.col("document_id").alias("doc_id"), "ordinal", "size_chars", "estimated_tokens", "content_hash")


def _pack(name: str, source: str, keys: str, limit: int, gap: str) -> str:
    """Greedy packing in SQL: source has keys, k (1, 2, …) and u; name gets keys, n and body. State is the body so far."""
    same = " AND ".join(f"r.{k} = s.{k}" for k in keys.split(", "))
    mine = ", ".join(f"r.{k}" for k in keys.split(", "))
    fits = f"length(body) + length({gap}) + length(u) <= {limit}"
    return f"""{name}_r({keys}, k, n, body) AS (SELECT {keys}, 1::BIGINT, 0::BIGINT, u FROM {source} WHERE k = 1
  UNION ALL SELECT {mine}, s.k, CASE WHEN {fits} THEN n ELSE n + 1 END, CASE WHEN {fits} THEN body || {gap} || u ELSE u END FROM {name}_r r JOIN {source} s ON {same} AND s.k = r.k + 1),
{name} AS (SELECT {keys}, n, arg_max(body, k) AS body FROM {name}_r GROUP BY ALL)"""


_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
CHUNK_SQL = rf"""WITH RECURSIVE ls AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
l AS (SELECT doc_id, i, regexp_replace(x[i], '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM ls) WHERE trim(regexp_replace(x[i], '\s+', ' ', 'g')) <> ''),
ss AS (SELECT doc_id, i, list_filter(string_split(regexp_replace(t, '([.!?]){_WS}', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> '') AS x FROM l WHERE length(t) > 1600),
se AS (SELECT doc_id, i, j, x[j] AS t FROM (SELECT doc_id, i, x, unnest(range(1, len(x) + 1)) AS j FROM ss)),
ws AS (SELECT doc_id, i, j, string_split_regex(t, '\s+') AS x FROM se WHERE length(t) > 1600),
wo AS (SELECT doc_id, i, j, k, x[k] AS u FROM (SELECT doc_id, i, j, x, unnest(range(1, len(x) + 1)) AS k FROM ws)),
{_pack("pw", "wo", "doc_id, i, j", 1600, "' '")},
un AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, i ORDER BY j, n) AS k, u FROM (SELECT doc_id, i, j, 0 AS n, t AS u FROM se WHERE length(t) <= 1600 UNION ALL SELECT doc_id, i, j, n, body FROM pw)),
{_pack("ps", "un", "doc_id, i", 1600, "' '")},
sg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, n) AS k, u FROM (SELECT doc_id, i, 0 AS n, t AS u FROM l WHERE length(t) <= 1600 UNION ALL SELECT doc_id, i, n, body FROM ps)),
{_pack("pc", "sg", "doc_id", 1200, "chr(10) || chr(10)")}
SELECT doc_id, n::INT AS ordinal, length(body)::INT AS size_chars, (length(body) + 3) // 4 AS estimated_tokens, sha256(source || chr(0) || body) AS content_hash FROM pc JOIN documents USING (doc_id)"""


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages cleaned, chunked with headings and overlap."""
    documents = html.source_documents(html.clean_pages(pages(spark, d)))
    blocks = documents.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.*")
    about = documents.select("document_id", F.col("canonical_url").alias("source_url"), "title")
    return chunk.chunks(blocks, about).select("id", "document_id", "ordinal", "source_url", F.array_join("heading_path", " / ").alias("heading"), "size_chars", "estimated_tokens", "content_hash")


# pages


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return html.clean_pages(pages(spark, d)).select("page_id", "title", "effective_url")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return html.parse_pages(pages(spark, d)).select("page_id", F.posexplode("links").alias("pos", "link"))


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return html.parse_pages(pages(spark, d)).select("page_id", F.posexplode("headings").alias("pos", "h")).select("page_id", "pos", "h.level", "h.text")


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return html.clean_pages(pages(spark, d)).select("page_id", F.explode("blocks").alias("b")).select("page_id", "b.pos", "b.kind", "b.text", F.array_join("b.heading_path", " / ").alias("heading"))


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    p = html.parse_pages(pages(spark, d))
    return p.select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("links").alias("links"), F.size("images").alias("images"), F.size("tables").alias("tables"), F.size("lists").alias("lists"), "metadata.description")


def source_documents(spark: SparkSession, d: str) -> DataFrame:
    return html.source_documents(html.clean_pages(pages(spark, d))).select("page_id", "document_id", "content_hash", "cleaned_bytes", "cleaned_tokens")


# store


def exact_dedup_contents(spark: SparkSession, d: str) -> DataFrame:
    h = docs(spark, d).select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "doc_id")
    return h.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def bridge(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document as a chunk: document_id, content_hash, ordinal, chunk_hash."""
    return docs(spark, d).select(F.col("doc_id").alias("document_id"), digest(F.col("text")).alias("content_hash"), F.posexplode(F.split("text", "\n")).alias("ordinal", "t")).select("document_id", "content_hash", "ordinal", digest(F.col("t")).alias("chunk_hash"))


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").alias("document_id"), F.concat(F.lit("https://"), "source", F.lit("/"), (F.col("doc_id") % 97).cast("string")).alias("canonical_url"), digest(F.col("text")).alias("content_hash"))


def provenance_pick(spark: SparkSession, d: str) -> DataFrame:
    return store.provenance(bridge(spark, d).select("content_hash", "ordinal", "chunk_hash").distinct(), documents_of(spark, d))


def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    """Odd documents as a batch over a store of the even ones."""
    even, odd = F.col("document_id") % 2 == 0, F.col("document_id") % 2 == 1
    dd, bb = documents_of(spark, d), bridge(spark, d)
    return store.batch_counts(dd.where(odd), bb.where(odd), dd.where(even).select("content_hash").distinct(), bb.where(even).select("chunk_hash").distinct())


def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that no document of the first half has."""
    b = bridge(spark, d)
    return store.orphans(b.select("chunk_hash").distinct(), b.where("document_id % 2 = 0"), "chunk_hash")


def live_contents(spark: SparkSession, d: str) -> DataFrame:
    x = documents_of(spark, d)
    return store.live(x.select("content_hash").distinct(), x.where("document_id % 3 = 0"), "content_hash")


def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth document is crawled again, with another title."""
    old = docs(spark, d).select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.lit(1).alias("seq"))
    new = old.where("document_id % 5 = 0").select("document_id", F.concat("title", F.lit("-again")).alias("title"), (F.lit(2) + F.col("document_id") % 2).alias("seq"))
    return store.upserted(old, new.union(new.withColumn("seq", F.lit(9)).where("document_id % 10 = 0")))


def hash_collisions(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select(F.substr(F.sha2(F.col("text").cast("binary"), 256), F.lit(1), F.lit(2)).alias("key"), "text")
    return store.collisions(x, "key", "text")


def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    """Runs of turns of one role in a conversation, as sections of one heading path."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    blocks = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("pos"), F.lit("paragraph").alias("kind"), "text", F.array("role").alias("heading_path"))
    return chunk.sections(blocks).groupBy(F.col("document_id").alias("conv_id"), "section").agg(F.first(F.col("heading_path")[0]).alias("role"), F.min("pos").alias("first_turn"), F.count("*").alias("turns"))


LINES_SQL = "b AS (SELECT doc_id AS document_id, sha256(text) AS content_hash, unnest(range(0, len(string_split(text, chr(10))))) AS ordinal, sha256(unnest(string_split(text, chr(10)))) AS chunk_hash FROM documents), dd AS (SELECT doc_id AS document_id, 'https://' || source || '/' || (doc_id % 97) AS canonical_url, sha256(text) AS content_hash FROM documents)"
EVIDENCE_SQL = r"regexp_replace(lower(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))), '\s+([.,;:!?])', '\1', 'g')"

QUERIES = {
    f.__name__: f
    for f in (
        size_stats, sentence_split, hard_slices, overlap_suffixes, evidence_form, chunk_documents, chunk_pages, page_titles, page_links, page_headings, page_blocks, page_fields, source_documents, exact_dedup_contents, provenance_pick,
        dedup_counts, orphan_chunks, live_contents, document_upsert, hash_collisions, heading_sections,
    )
}
ORACLES = {
    "size_stats": "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, sum((length(text) + 3) // 4)::BIGINT AS tokens FROM documents GROUP BY lang",
    "sentence_split": r"""WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
f AS (SELECT doc_id, list_filter(s, lambda x: trim(x) <> '') AS s FROM m) SELECT doc_id, (unnest(range(0, len(s))))::INT AS pos, md5(unnest(s)) AS sentence_md5 FROM f""",
    "hard_slices": "WITH p AS (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents) SELECT doc_id, i::INT AS pos, length(substr(text, 500 * i + 1, 500))::INT AS n, md5(substr(text, 500 * i + 1, 500)) AS slice_md5 FROM p",
    "overlap_suffixes": r"""WITH t AS (SELECT doc_id, text, right(text, 160) AS s, position(' ' IN right(text, 160)) AS b FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE regexp_replace(CASE WHEN b > 0 AND b < length(s) THEN substr(s, b + 1) ELSE s END, '^\s+|\s+$', '', 'g') END AS suffix FROM t""",
    "evidence_form": f"SELECT doc_id, md5({EVIDENCE_SQL}) AS evidence_md5 FROM documents",
    "chunk_documents": CHUNK_SQL,
    "page_titles": r"SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS title, regexp_replace(url, '#.*$', '') AS effective_url FROM pages",
    "page_headings": r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS x FROM pages), e AS (SELECT page_id, unnest(range(0, len(x))) AS pos, unnest(x) AS t FROM h) SELECT page_id, pos::INT AS pos, 1 AS level, trim(replace(t, '&amp;', '&')) AS text FROM e""",
    "page_links": r"""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS x FROM pages),
e AS (SELECT page_id, unnest(range(0, len(x))) AS i, CASE WHEN starts_with(unnest(x), '/') THEN origin || unnest(x) ELSE unnest(x) END AS link FROM a),
f AS (SELECT page_id, link, min(i) AS i FROM (SELECT page_id, i, regexp_replace(replace(link, '&amp;', '&'), '#.*$', '') AS link FROM e) GROUP BY ALL) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, link FROM f""",
    "exact_dedup_contents": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1",
    "provenance_pick": f"WITH {LINES_SQL}, r AS (SELECT chunk_hash, canonical_url, d.document_id, ordinal, row_number() OVER (PARTITION BY chunk_hash ORDER BY canonical_url, d.document_id, ordinal) AS k FROM (SELECT DISTINCT content_hash, ordinal, chunk_hash FROM b) x JOIN dd d USING (content_hash)) SELECT chunk_hash, canonical_url, document_id, ordinal::INT AS ordinal FROM r WHERE k = 1",
    "dedup_counts": f"""WITH {LINES_SQL}, n AS (SELECT count(*) AS documents, count(DISTINCT content_hash) FILTER (WHERE content_hash NOT IN (SELECT content_hash FROM dd WHERE document_id % 2 = 0)) AS new_contents FROM dd WHERE document_id % 2 = 1),
c AS (SELECT count(*) AS chunks, count(DISTINCT chunk_hash) FILTER (WHERE chunk_hash NOT IN (SELECT chunk_hash FROM b WHERE document_id % 2 = 0)) AS new_chunks FROM b WHERE document_id % 2 = 1)
SELECT documents, new_contents, documents - new_contents AS duplicate_contents, chunks, new_chunks, chunks - new_chunks AS duplicate_chunks FROM n, c""",
    "orphan_chunks": f"WITH {LINES_SQL} SELECT DISTINCT chunk_hash FROM b WHERE chunk_hash NOT IN (SELECT chunk_hash FROM b WHERE document_id % 2 = 0)",
    "live_contents": f"WITH {LINES_SQL} SELECT DISTINCT content_hash FROM dd WHERE document_id % 3 = 0",
    "document_upsert": "SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN source || '-again' ELSE source END AS title, (CASE WHEN doc_id % 10 = 0 THEN 9 WHEN doc_id % 5 = 0 THEN 2 + doc_id % 2 ELSE 1 END)::BIGINT AS seq FROM documents",
    "hash_collisions": "SELECT substr(sha256(text), 1, 2) AS key, count(DISTINCT text) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT text) > 1",
    "heading_sections": r"""WITH c AS (SELECT * FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''), l AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM l) SELECT conv_id, section::BIGINT AS section, any_value(role) AS role, min(turn) AS first_turn, count(*) AS turns FROM g GROUP BY conv_id, section""",
}
