"""One object over store, retrieval and context: what a user of the engine calls."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.config import CrawlConfig
from webskein.functions import urls as address
from webskein.functions.text import digest
from webskein.operators import context, crawl, fusion, lexical, semantic
from webskein.operators.chunk import ChunkConfig
from webskein.operators.store import Snapshot, Store, provenance
from webskein.plans.staging import stage
from webskein.sources import http
from webskein.streaming.ingest import batch_of


class Engine:
    """Pages in, ranked chunks and bounded context out. Queries come as a table (query_id, query), so that many are answered by one plan."""

    def __init__(self, spark: SparkSession, path: str, config: ChunkConfig = ChunkConfig()):
        self.spark, self.store, self.config = spark, Store(spark, path), config

        self._indexes: dict[str | None, lexical.Index] = {}

    def index_pages(self, pages: DataFrame) -> dict:
        """pages: page_id, url, html. Returns the batch's counts."""
        return self.store.index(*batch_of(pages, self.config))

    def crawl(self, seeds: DataFrame, config: CrawlConfig = CrawlConfig(), fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Crawl from ``seeds`` (url) by a configuration and index each level's pages: url, depth, status, problem of every attempt."""
        one = functools.partial(http.fetch, agent=config.user_agent, cap=config.max_bytes, timeout=config.timeout)
        get = fetch or (lambda urls: http.fetched(urls, max(config.min_delay, 1 / config.requests_per_second), one))

        def admit(urls: DataFrame) -> DataFrame:
            urls = crawl.admitted(urls, domains=config.domains or None, include=config.include, exclude=config.exclude)
            return urls if config.allow_private else crawl.policy(urls).where("refused is null").drop("refused")

        def fetch_admitted(urls: DataFrame) -> DataFrame:
            return self._robots_filtered(urls, get, config.user_agent) if config.respect_robots else get(urls)

        save = lambda pages: None if pages.isEmpty() else self.index_pages(pages.select(F.monotonically_increasing_id().alias("page_id"), "url", "html"))
        return crawl.crawl(seeds, fetch_admitted, config.max_depth, config.max_pages, admit, save=save, attempts=config.retries + 1)

    def _robots_filtered(self, urls: DataFrame, get: Callable[[DataFrame], DataFrame], agent: str) -> DataFrame:
        """What robots files allow is fetched; the rest are attempts with a problem. An origin's file is fetched once for a level."""
        u = urls.select("url", address.origin(F.col("url")).alias("origin"), F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]*", "").alias("path"))
        files = stage(get(u.select(address.robots_url(F.col("url")).alias("url")).distinct()), "robots").withColumn("said", crawl.robots_available(F.col("status")))
        text = F.when(F.col("said") == "read", F.col("html")).when(F.col("said") == "deny", "User-agent: *\nDisallow: /").otherwise("")
        robots = files.select(address.origin(F.col("url")).alias("origin"), crawl.robots_groups(text).alias("groups"))
        decided = stage(crawl.robots_decisions(u, robots, agent).select("url", "allowed"), "decided")
        refused = decided.where("not allowed").select("url", F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("html"), F.lit("Blocked by robots.txt").alias("problem"))
        return get(decided.where("allowed").select("url")).unionByName(refused)

    def versions(self) -> list[str]:
        return [p.split("-", 1)[1] for p in self.store.pointers()]

    def info(self) -> DataFrame:
        return self.store.info()

    def queries(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts, 1)], "query_id string, query string")

    def lexical_index(self, at: Snapshot) -> lexical.Index:
        """The postings of a version, built at its first search."""
        if at.version not in self._indexes:
            self._indexes = {at.version: lexical.build(lexical.tokenised(at.read("chunks"), "chunk_hash", "text", "title", "heading"))}
        return self._indexes[at.version]

    def _hits(self, ranked: DataFrame, at: Snapshot) -> DataFrame:
        """Ranked chunk hashes with text and source; top-k first, hydration after. The chunk's id is that of its place in the chosen source."""
        chunks, docs = at.read("chunks"), at.read("documents")
        source = provenance(at.read("content_chunks"), docs)
        about = docs.select("document_id", "url", "source_tokens", F.col("title").alias("document_title"))
        hit = ranked.withColumnRenamed("key", "chunk_hash").join(chunks, "chunk_hash").join(source, "chunk_hash").join(about, "document_id")
        chunk_id = digest(F.col("document_id"), F.col("ordinal"), F.col("chunk_hash")).alias("chunk_id")
        return hit.select("query_id", "rank", "score", "chunk_hash", chunk_id, "text", "heading", "n_tokens", "document_id", "canonical_url", "url", "document_title", "ordinal", "source_tokens")

    def readiness(self, vectors: DataFrame) -> DataFrame:
        """One row: lexical_ready, semantic_ready, ready, of the current version. vectors: key (chunk hash), vector."""
        at = self.store.snapshot()
        return fusion.readiness(at.read("chunks").agg(F.count("*").alias("n_chunks")), self._covers(at, vectors))

    def _covers(self, at: Snapshot, vectors: DataFrame) -> DataFrame:
        own = vectors.select(F.col("key").alias("chunk_hash"), "vector", F.lit("m").alias("model_fingerprint"))
        return semantic.readiness(at.read("chunks").select("chunk_hash"), own, "m")

    def embed(self, make: Callable[[], semantic.Provider], vectors: DataFrame | None = None) -> DataFrame:
        """key, vector, model_fingerprint for every chunk, by ``make``'s model: chunks that ``vectors`` has aren't embedded again, and stale vectors go. A failed batch's chunks stay without."""
        provider, at = make(), self.store.snapshot()
        old = vectors.withColumnRenamed("key", "chunk_hash") if vectors is not None else self.spark.createDataFrame([], "chunk_hash string, vector array<float>, model_fingerprint string")
        chunks = at.read("chunks")
        text = semantic.document_text(F.col("title"), F.split("heading", " / "), F.col("text"))
        todo = semantic.missing(chunks, old, provider.fingerprint).select("chunk_hash", text.alias("text"))
        new = stage(semantic.embedded(todo, make), "embedded").where("error is null")
        return stage(semantic.stored(old, new, chunks, provider.fingerprint, provider.dimension), "vectors").withColumnRenamed("chunk_hash", "key")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        at = self.store.snapshot()
        return self._hits(lexical.search(self.lexical_index(at), queries, k), at)

    def search_semantic(self, vectors: DataFrame, query_vectors: DataFrame, k: int = 5, normalised: bool = True) -> DataFrame:
        """vectors: key (chunk hash), vector; query_vectors: query_id, vector. Without a vector for every chunk this is refused; vectors of chunks that are gone take no part."""
        at = self.store.snapshot()
        chunks = at.read("chunks").select(F.col("chunk_hash").alias("key"))
        if not chunks.isEmpty() and not self._covers(at, vectors).first().ready:
            raise RuntimeError("the vectors don't cover the index")
        return self._hits(semantic.search(vectors.join(chunks, "key", "left_semi"), query_vectors, k, normalised), at)

    def search_hybrid(self, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 5, depth: int = 50, weights: tuple[float, float] = (1.0, 1.0), rrf: float = 60.0) -> DataFrame:
        """Both rankings and their texts come from one version of the store. An invalid ranking is an error, never repaired; one that fails is a RetrievalError that names it."""
        if depth < k or max(weights) <= 0 or min(weights) < 0:
            raise ValueError("depth of at least k and a positive weight are needed")
        at = self.store.snapshot()
        chunks = at.read("chunks").select(F.col("chunk_hash").alias("key"))
        parts = []
        lists = (("bm25", weights[0], lambda: lexical.search(self.lexical_index(at), queries, depth)), ("semantic", weights[1], lambda: semantic.search(vectors.join(chunks, "key", "left_semi"), query_vectors, depth)))
        for name, weight, make in lists:
            try:
                parts.append(stage(make().select("query_id", F.lit(name).alias("strategy"), F.lit(float(weight)).alias("weight"), "key", "rank", F.col("score").alias("raw_score")), "ranking"))
            except Exception as e:
                raise fusion.RetrievalError(name, e) from e
        both = parts[0].union(parts[1])
        if not (bad := fusion.problems(both)).isEmpty():
            raise ValueError(f"invalid ranking: {bad.first().asDict()}")
        return self._hits(fusion.fuse(both, rrf, k).select("query_id", "rank", "key", "score"), at)

    def build_context(self, hits: DataFrame, budget: int = 3000) -> DataFrame:
        """The context of each query: counts, tokens, reduction and the selected chunks' text in rank order."""
        slim = hits.select("query_id", "rank", F.col("chunk_hash").alias("content_hash"), "document_id", F.col("n_tokens"), "source_tokens")
        chosen = context.select_context(slim, budget)
        each = chosen.select("query_id", F.explode("selected").alias("s")).select("query_id", "s.rank").join(hits.select("query_id", "rank", "text", "canonical_url"), ["query_id", "rank"])
        texts = each.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "canonical_url"))), lambda x: F.struct(x["text"].alias("text"), x["canonical_url"].alias("source"))).alias("chunks"))
        return chosen.drop("selected").join(texts, "query_id", "left")
