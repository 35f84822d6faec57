"""Exact cosine retrieval, and the life of an embedding table: planning, embedding, validation, storing, purging, readiness."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webskein.operators.lexical import first_k, top


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str, normalised: bool = True) -> Column:
    """Cosine in double precision, clamped to [-1, 1]; without ``normalised`` norms are divided out and a zero vector is an error."""
    x = dot(a, b)
    if not normalised:
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        x = F.when(norms == 0, F.raise_error(F.lit("zero vector"))).otherwise(x / F.nullif(norms, F.lit(0.0)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    x = lists.combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(x), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, normalised: bool = True, block: int = 4096, pack: int = 65_536, cells: int = 1 << 22) -> DataFrame:
    """query_id, rank, key, score, best first, equal scores (to 9 digits) by key. vectors: key, vector; queries: query_id, vector.

    Every vector meets every query, as asked for: rows are packed and queries blocked by hash, each pack and block meet in one equi-join, and matrix products of about ``cells`` scores at once score them. A
    pack sends a query's k best and no more. A query or row of another dimension than its block's is an error."""
    blocks, packs = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (vectors, pack)))
    ids = dict(vectors.dtypes)["key"], dict(queries.dtypes)["query_id"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "key", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([right["query_id"].slice(0, 0), left["key"].slice(0, 0), pa.array([], pa.float64())], names=names)
        key = left["key"].combine_chunks()
        by_key = np.argsort(key.to_numpy(zero_copy_only=False), kind="stable")
        x, q = _matrix(left["vector"])[by_key], _matrix(right["vector"])
        if not normalised:
            one, two = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            if not one.all() or not two.all():
                raise ValueError("zero vector")
            x, q = x / one[:, None], q / two[:, None]
        row, column, score = [], [], []
        step = max(1, cells // len(x))
        for at in range(0, len(q), step):
            s = np.clip(q[at : at + step] @ x.T, -1.0, 1.0)
            for i, own in enumerate(s):
                there = first_k(np.round(own, 9), k)
                row.append(np.full(len(there), at + i))
                column.append(there)
                score.append(own[there])
        return pa.Table.from_arrays([right["query_id"].take(pa.array(np.concatenate(row))), key.take(pa.array(by_key[np.concatenate(column)])), pa.array(np.concatenate(score))], names=names)

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    here = vectors.select("key", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("key"), F.lit(packs)).alias("pack"), every(blocks).alias("block"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), every(packs).alias("pack"))
    each = here.groupBy("pack", "block").cogroup(asked.groupBy("pack", "block")).applyInArrow(best, f"query_id {ids[1]}, key {ids[0]}, score double")
    return top(each, k, F.desc(F.round("score", 9)), F.col("key")).select("query_id", "rank", "key", "score")


def validated(vectors: DataFrame, dimension: int, unit: bool = True, tolerance: float = 1e-4) -> DataFrame:
    """``vectors`` with ``problem``: null where a vector is whole, of this dimension, finite and, if asked for, of unit length."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(dot("vector", "vector"))
    return vectors.withColumn(
        "problem",
        F.when(F.col("vector").isNull(), "missing").when(F.size("vector") != dimension, "dimension").when(bad, "not finite").when(F.lit(unit) & (F.abs(norm - 1) > tolerance), "not normalised"),
    )


def missing(chunks: DataFrame, vectors: DataFrame, fingerprint: str) -> DataFrame:
    """Chunks that have no vector of this model."""
    return chunks.join(vectors.where(F.col("model_fingerprint") == fingerprint).select("chunk_hash"), "chunk_hash", "left_anti")


def stale(chunks: DataFrame, vectors: DataFrame, fingerprint: str, dimension: int) -> DataFrame:
    """Vectors of this model of another dimension, or whose chunk is gone."""
    own = vectors.where(F.col("model_fingerprint") == fingerprint)
    return own.where(F.size("vector") != dimension).union(own.where(F.size("vector") == dimension).join(chunks.select("chunk_hash"), "chunk_hash", "left_anti"))


def readiness(chunks: DataFrame, vectors: DataFrame, fingerprint: str) -> DataFrame:
    """One row: n_chunks, n_vectors (of this model, for chunks that are there), n_missing, n_stale (for chunks that are gone), stored_bytes, n_other (vectors of other models), ready.

    Each chunk is looked for among the vectors: equal counts alone would take a stale vector for a missing one."""
    own = F.col("model_fingerprint") == fingerprint
    has = vectors.where(own).select("chunk_hash").distinct().withColumn("has", F.lit(True))
    c = chunks.select("chunk_hash").join(has, "chunk_hash", "left").agg(F.count("*").alias("n_chunks"), F.count_if("has").alias("n_vectors"))
    gone = vectors.where(own).join(chunks.select("chunk_hash"), "chunk_hash", "left_anti").agg(F.count("*").alias("n_stale"))
    v = vectors.agg(F.coalesce(F.sum(F.when(own, F.size("vector") * 4)), F.lit(0)).cast("long").alias("stored_bytes"), F.count_if(~own).alias("n_other"))
    # three rows of one each
    return c.crossJoin(gone).crossJoin(v).select("n_chunks", "n_vectors", (F.col("n_chunks") - F.col("n_vectors")).alias("n_missing"), "n_stale", "stored_bytes", "n_other", ((F.col("n_chunks") > 0) & (F.col("n_chunks") == F.col("n_vectors"))).alias("ready"))


def document_text(title: Column, headings: Column, text: Column) -> Column:
    """What a model embeds of a chunk."""
    none = F.lit("")
    return F.concat(F.lit("Title: "), F.coalesce(title, none), F.lit("\nSection: "), F.coalesce(F.array_join(headings, " > "), none), F.lit("\n\n"), F.coalesce(text, none))


def query_text(query: Column) -> Column:
    """A query without white space around it; a blank one is an error."""
    bare = F.regexp_replace(query, r"^\s+|\s+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.raise_error(F.lit("semantic query must not be empty"))).otherwise(bare)


def plan(chunks: DataFrame, vectors: DataFrame, fingerprint: str, dimension: int) -> DataFrame:
    """One row, what embedding would do: considered, cache_hits, to_embed, to_purge (stale vectors, or ones of another dimension)."""
    whole = vectors.where((F.col("model_fingerprint") == fingerprint) & (F.size("vector") == dimension)).select("chunk_hash").distinct().withColumn("has", F.lit(True))
    c = chunks.select("chunk_hash").join(whole, "chunk_hash", "left").agg(F.count("*").alias("considered"), F.count_if("has").alias("cache_hits"))
    s = stale(chunks, vectors, fingerprint, dimension).agg(F.count("*").alias("to_purge"))
    return c.crossJoin(s).select("considered", "cache_hits", (F.col("considered") - F.col("cache_hits")).alias("to_embed"), "to_purge")


class Provider(Protocol):
    """An embedding model, made once in each worker."""

    fingerprint: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def sizes(self, texts: list[str]) -> list[int]:
        """Input lengths in the model's tokens."""


#: Words whose buckets are kept between texts, about; then they are forgotten.
WORDS = 1 << 18


class Places(dict):
    """Twice a word's bucket, and one more where its sign is positive."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        h = hashlib.md5(word.encode()).digest()
        self[word] = place = 2 * (int.from_bytes(h[:4], "little") % self.dimension) + (h[4] & 1)
        return place


class HashedWords:
    """A provider without a model: words hashed into ``dimension`` signed buckets, to unit length. The same text has the same vector everywhere."""

    def __init__(self, dimension: int = 64, limit: int = 8192):
        self.dimension, self.limit = dimension, limit
        self.places = Places(dimension)
        self.fingerprint = hashlib.sha256(f"hashed words {dimension} {limit}".encode()).hexdigest()

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            if len(self.places) > WORDS:
                self.places.clear()
            found = np.bincount(np.fromiter(map(self.places.__getitem__, t.lower().split()[: self.limit]), np.int64), minlength=2 * self.dimension)
            out[i] = found[1::2] - found[::2]
            out[i, 0] += not out[i].any()
        return (out / np.sqrt((out * out).sum(1))[:, None]).tolist()

    def sizes(self, texts: list[str]) -> list[int]:
        return [len(t.split()) for t in texts]


EMBEDDED = "chunk_hash string, vector array<float>, size long, error string"


def embedded(chunks: DataFrame, make: Callable[[], Provider], batch: int = 32) -> DataFrame:
    """chunk_hash, vector, size (of the input, in the model's tokens), error. chunks: chunk_hash, text. A batch that fails leaves rows with the error, and the others go on."""

    def run(batches):
        provider = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                keys, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
                try:
                    got, sizes, errors = provider.embed(texts), provider.sizes(texts), [None] * len(texts)
                    if len(got) != len(texts):
                        raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                except Exception as e:  # noqa: BLE001 - a provider is the user's
                    got, sizes, errors = [None] * len(texts), [None] * len(texts), [f"{type(e).__name__}: {e}"[:500]] * len(texts)
                yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(got, pa.list_(pa.float32())), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["chunk_hash", "vector", "size", "error"])

    return chunks.select(F.col("chunk_hash").cast("string").alias("chunk_hash"), "text").mapInArrow(run, EMBEDDED)


def rejected(new: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """chunk_hash, reason of vectors that may not be stored: unknown chunks, and what validated() finds."""
    unknown = new.join(chunks.select("chunk_hash"), "chunk_hash", "left_anti").select("chunk_hash", F.lit("unknown chunk").alias("reason"))
    known = new.join(chunks.select("chunk_hash"), "chunk_hash", "left_semi")
    return unknown.union(validated(known, dimension).where("problem is not null").select("chunk_hash", F.col("problem")))


def stored(vectors: DataFrame, new: DataFrame, chunks: DataFrame, fingerprint: str, dimension: int) -> DataFrame:
    """``vectors`` (chunk_hash, vector, model_fingerprint) after an upsert of this model's new ones; those that are rejected() don't come in, and this model's stale ones go."""
    good = validated(new.join(chunks.select("chunk_hash"), "chunk_hash", "left_semi"), dimension).where("problem is null")
    good = good.groupBy("chunk_hash").agg(F.min("vector").alias("vector")).withColumn("model_fingerprint", F.lit(fingerprint))
    own = F.col("model_fingerprint") == fingerprint
    kept = vectors.where(own & (F.size("vector") == dimension)).join(chunks.select("chunk_hash"), "chunk_hash", "left_semi").join(good.select("chunk_hash"), "chunk_hash", "left_anti")
    columns = ["chunk_hash", "vector", "model_fingerprint"]
    return vectors.where(~own).select(columns).union(kept.select(columns)).union(good.select(columns))


def pending(models: DataFrame, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """``models`` (model_fingerprint, further columns) with pending_invalidations: each model's vectors whose chunk is gone, by one join and aggregate instead of a count for each."""
    gone = vectors.join(chunks.select("chunk_hash"), "chunk_hash", "left_anti").groupBy("model_fingerprint").agg(F.count("*").alias("pending_invalidations"))
    return models.join(gone, "model_fingerprint", "left").withColumn("pending_invalidations", F.coalesce("pending_invalidations", F.lit(0)))


def input_statistics(batches: DataFrame) -> DataFrame:
    """Merge of batch statistics (n, truncated, longest, mean): sums, maximum and weighted mean."""
    n = F.sum("n")
    return batches.agg(n.alias("n"), F.sum("truncated").alias("truncated"), F.max("longest").alias("longest"), F.try_divide(F.sum(F.col("mean") * F.col("n")), n).alias("mean"))
