"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of ``books`` full-dimensional codewords, one from each residual codebook. Codebooks are fitted on a bounded sample (``sample`` vectors, drawn by the hash
of their id), book by book on what the earlier ones leave, and then refitted jointly by least squares. Encoding keeps the ``beam`` best partial sums. Each row's codes and the norm
of its sum are stored, with the norm of what the sum leaves; a query's score against a row is the sum's norm minus twice a sum of ``books`` entries of the query's lookup table. The ``rerank`` best rows of each query
are measured on the original vectors, in double precision. Their k-th distance bounds what is still to be found: every other row whose looked-up distance, less what its codes leave, isn't beyond it is measured too
(triangle inequality), so that no row that belongs to the k nearest is passed over, however the vectors lie: clusters with more members than ``rerank``, far means, unequal scales, many dimensions.

Defined results. Vectors that are null, of zero length, or hold a null or non-finite component take no part, nor do those of another length than the most frequent one. Of rows
that repeat an id, one with the smallest vector counts. Equal distances go to the smaller id. With fewer candidates than asked for, all are returned. An empty table gives no rows. Vectors of any length are taken whole. Only the two named columns are read; others may have any names.

Scale. Every row is encoded. Rows are packed by at most about ``pack`` (fewer where vectors are long) and queries by ``block``; each block of queries meets each pack once, through
an equi-join on both numbers, in bounded memory, and a pack sends a query's k best and no more. Rows, codes and vectors, move once for each block, queries once for each pack; up to 13 million rows there is one block. How many rows
are measured depends on how near the codes come: where they tell nothing, a task measures its whole pack.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webskein.llm.langid import drawn
from webskein.plans.staging import stage


class Quantiser:
    """Codebooks of shape (books, words, dim)."""

    def __init__(self, codebooks: np.ndarray, beam: int):
        self.codebooks, self.beam = codebooks, beam
        self.flat = codebooks.reshape(-1, codebooks.shape[2])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) by beam search, and squared norms of the sums."""
        m, k, _ = self.codebooks.shape
        gram = self.flat @ self.flat.T
        own = np.diag(gram)
        out = np.empty((len(x), m), np.uint8)
        norms = np.empty(len(x), np.float32)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            dots = part @ self.flat.T
            n = len(part)
            codes, cost, cross = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32), np.zeros((n, 1, m * k), np.float32)
            for b in range(m):
                s = slice(b * k, b * k + k)
                # |x - s - c|^2 - |x - s|^2 = |c|^2 - 2 x.c + 2 s.c
                new = cost[:, :, None] + (own[s] - 2 * dots[:, s])[:, None, :] + 2 * cross[:, :, s]
                wide = new.reshape(n, -1)
                keep = min(self.beam, wide.shape[1])
                best = np.argpartition(wide, keep - 1, axis=1)[:, :keep] if keep < wide.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
                row = np.arange(n)[:, None]
                old, word = best // k, best % k
                cost = wide[row, best]
                codes = np.concatenate([codes[row, old], word[:, :, None]], 2)
                cross = cross[row, old] + gram[b * k + word]
            top = cost.argmin(1)
            chosen = codes[np.arange(n), top]
            out[at : at + n] = chosen
            norms[at : at + n] = (self.codebooks[np.arange(m)[None, :], chosen].sum(1) ** 2).sum(1)
        return out, norms


def by_word(codes: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The sum of the vectors of each codeword."""
    return np.stack([np.bincount(codes, weights=x[:, d], minlength=k) for d in range(x.shape[1])], 1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        sums = by_word(near, x, k)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return c


def fit(x: np.ndarray, books: int, words: int, beam: int, rounds: int = 2, seed: int = 3) -> Quantiser:
    """Residual codebooks, refitted jointly ``rounds`` times by ridge least squares on beam-search codes."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float32)
    rest, found = x.copy(), []
    for _ in range(books):
        c = kmeans(rest, words, rng)
        rest -= c[((c * c).sum(1) - 2 * rest @ c.T).argmin(1)]
        found.append(c)
    q = Quantiser(np.stack(found).astype(np.float32), beam)
    for _ in range(rounds):
        codes, _ = q.encode(x)
        size = books * words
        a = np.zeros((size, size))
        for i in range(books):
            for j in range(books):
                a[i * words : (i + 1) * words, j * words : (j + 1) * words] = np.bincount(codes[:, i].astype(np.int64) * words + codes[:, j], minlength=words * words).reshape(words, words)
        right = np.concatenate([by_word(codes[:, i], x, words) for i in range(books)])
        a[np.diag_indices(size)] += 0.1
        right += 0.1 * q.flat
        q = Quantiser(np.linalg.solve(a, right).reshape(q.codebooks.shape).astype(np.float32), beam)
    return q


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v (array<float> where it was, else array<double>) of the rows that take part."""
    kind = dict(rows.dtypes)[vector]
    v = F.col(vector).cast(kind if kind == "array<float>" else "array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def _matrix(lists: pa.Array, dtype=np.float64) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False)
    return x.astype(dtype or x.dtype, copy=False).reshape(len(lists), -1)


def nearest(rows: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", books: int = 40, words: int = 16, beam: int = 4, sample: int = 8192, rerank: int = 192, pack: int = 262_144, block: int = 131_072) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by Euclidean distance, other than the query itself."""
    spark = rows.sparkSession
    own = stage(usable(rows, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    total = own.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    train = np.array([r.v for r in drawn(own, F.col("vec_id"), total, sample, "ann").select("v").collect()[:sample]] or [own.first().v])
    train = train.astype(np.float64)
    center = train.mean(0)
    scale = float(np.abs(train - center).max()) or 1.0
    model = spark.sparkContext.broadcast((fit((train - center) / scale, books, words, beam), center, scale))

    def encode(batches):
        q, mean, unit = model.value
        for b in batches:
            if b.num_rows:
                x = (_matrix(b.column(1)) - mean) / unit
                with np.errstate(over="ignore", invalid="ignore"):  # a row far beyond the sample has poor codes, and a large rest
                    codes, _ = q.encode(x.astype(np.float32))
                sums = q.codebooks[np.arange(books)[None, :], codes].astype(np.float64).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((sums * sums).sum(1)), pa.array(np.sqrt(((x - sums) ** 2).sum(1)))], names=["vec_id", "v", "codes", "norm", "rest"])

    pack = min(pack, max(4096, (1 << 24) // train.shape[1]))
    packs = max(-(-total // pack), min(2 * spark.sparkContext.defaultParallelism, total // 4096), 1)
    even = rerank / packs
    share = max(k + 1, min(rerank, ceil(even + 6 * sqrt(even) + 6)))
    coded = own.mapInArrow(encode, f"vec_id long, v {dict(own.dtypes)['v']}, codes binary, norm double, rest double").withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(packs)))
    queries = own.where(is_query)
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // block))
    asked = queries.select(F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(blocks)).alias("block"), "vec_id", "v")

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """A pack of rows and a block of queries: each query's k best."""
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        quantiser, mean, unit = model.value
        ids, norms, rest = (left[c].to_numpy() for c in ("vec_id", "norm", "rest"))
        codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(ids), -1).T.astype(np.int64)
        # one lookup for two books, an odd last one alone
        codes = [codes[b] * words + codes[b + 1] if b + 1 < books else codes[b] for b in range(0, books, 2)]
        vectors = np.ascontiguousarray(_matrix(left["v"].combine_chunks(), None).T)
        q_ids, q = right["vec_id"].to_numpy(), _matrix(right["v"].combine_chunks())
        flat, longest, entries = quantiser.flat.astype(np.float64), float(norms.max()), np.empty(len(ids))

        def measured(i: int, which: np.ndarray) -> np.ndarray:
            """Distances on the original vectors, component by component as SQL adds them."""
            d = np.zeros(len(which))
            for x, y in zip(vectors, q[i]):
                d += (x[which].astype(np.float64) - y) ** 2
            return np.sqrt(d)

        out = []
        for i, own_id in enumerate(q_ids):
            z = (q[i] - mean) / unit
            t, size = 2 * (flat @ z).reshape(books, words), float(z @ z)
            looked_up = norms + size
            for b, code in enumerate(codes):
                table = (t[2 * b][:, None] + t[2 * b + 1]).ravel() if 2 * b + 1 < books else t[2 * b]
                looked_up -= table.take(code, out=entries, mode="clip")
            other = ids != own_id
            first = np.argpartition(looked_up, share)[:share] if len(ids) > share else np.arange(len(ids))
            first = first[other[first]]
            which, d = first, measured(i, first)
            if len(ids) > share:
                bound = np.partition(d, k - 1)[k - 1] / unit
                # lengths and sums of doubles err by less than this
                error = 1e-6 * (sqrt(size) + sqrt(longest) + bound) + 1e-9 * bound
                near = other & ~(np.sqrt(np.maximum(looked_up, 0)) - rest > bound + error)  # what isn't a number is measured
                near[first] = False
                more = np.flatnonzero(near)
                which, d = np.concatenate([first, more]), np.concatenate([d, measured(i, more)])
            best = np.lexsort((ids[which], d))[:k]
            out.append((np.full(len(best), own_id), ids[which[best]], d[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)

    # every block of queries is sent to every pack: an equi-join on both numbers
    met = asked.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))))
    here = coded.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = here.groupBy("pack", "block").cogroup(met.groupBy("pack", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_reduce(list_transform(list_zip(e.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda s, x: s + x, 0.0::DOUBLE)) AS score
      FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
