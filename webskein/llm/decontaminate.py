"""Benchmark decontamination by spaced-seed hashing.

Tokens are words after lower-casing A-Z with ASCII signs taken as blanks. Each mask is slid over benchmark items and documents and hashes the
tokens at its set positions, so that a hit survives substitutions at the others. Items shorter than the longest mask have masks of their own length, one for each choice of as
many free positions as may differ, so that none of their matches is missed. Around a hit, item and document are aligned and the best stretch is found (+1 for an equal token, -4 for another one, so that at
least 80 % of it are equal). A pair is contaminated if that stretch has ``matched`` equal tokens, or 80 % of a shorter item.

Defined results. Null or wordless texts and items have no tokens and are never found. A repeated item counts once, by its best stretch; repeated
documents each give their rows; a null doc_id or item_id is carried as null. Whole texts of any length are read. Empty tables give no rows. Only the named columns are read.

Scale. The benchmark is taken in blocks of at most ``block_mb`` of text (a longer item stands alone), which bounds each broadcast; documents are
read once for each block and never shuffled, so no key can be hot. Real test sets are one block.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.llm.quality import PLAIN
from webskein.llm.text import GOLD, M2, filtered, hashes, mix

MASKS = ("11101101", "1101001101", "11001010111")
LONGEST = max(map(len, MASKS))


def tokens(text: bytes | None) -> np.ndarray:
    return hashes((text or b"").lower().translate(PLAIN).split())


def seeds(t: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each place of a token sequence."""
    n = len(t) - len(mask) + 1
    if n <= 0:
        return t[:0]
    out = np.full(n, np.uint64(int(mask, 2) + (len(mask) << 20)))
    for i, x in enumerate(mask):
        if x == "1":
            out = out * M2 + t[i : i + n] * GOLD
            out ^= out >> np.uint64(31)
    return mix(out)


def needed(n: int, matched: int) -> int:
    """Equal tokens that contaminate, of an item of n tokens."""
    return min(matched, -(-4 * n // 5))


def masks_for(n: int, matched: int) -> list[str]:
    """The masks by which an item of n tokens is sought."""
    if n >= LONGEST:
        return list(MASKS)
    return ["".join("0" if i in free else "1" for i in range(n)) for free in combinations(range(n), n - needed(n, matched))] if n else []


class Index:
    """The seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, bytes | None]], matched: int = 13):
        self.ids = [i for i, _ in items]
        self.tokens = [tokens(t) for _, t in items]
        self.need = [needed(len(t), matched) for t in self.tokens]
        self.masks = sorted({m for n in {min(len(t), LONGEST) for t in self.tokens} for m in masks_for(n, matched)})
        found = []
        for i, t in enumerate(self.tokens):
            for m in masks_for(len(t), matched):
                h = seeds(t, m)
                found.append((h, np.full(len(h), i, np.int32), np.arange(len(h), dtype=np.int32)))
        h, self.item, self.at = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], self.item[order], self.at[order]
        self.bits = max(10, (32 * len(h)).bit_length())
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def hits(self, t: np.ndarray) -> set[tuple[int, int]]:
        """(item's number, place in the document of the item's first token) of each seed in common."""
        if self._table is None:
            self._table = np.zeros(1 << self.bits, bool)
            self._table[self.hash >> np.uint64(64 - self.bits)] = True
        out: set[tuple[int, int]] = set()
        for m in self.masks:
            h = seeds(t, m)
            p = np.flatnonzero(self._table[h >> np.uint64(64 - self.bits)])
            if not len(p):
                continue
            lo, hi = np.searchsorted(self.hash, h[p], "left"), np.searchsorted(self.hash, h[p], "right")
            for k in np.flatnonzero(hi > lo):
                s = slice(lo[k], hi[k])
                out.update(zip(self.item[s].tolist(), (p[k] - self.at[s]).tolist()))
        return out

    def find(self, text: bytes | None) -> list[tuple[object, int, int, int]]:
        """(item's id, equal tokens, length of the stretch, its first token in the document), the best of each contaminating item."""
        t, best = tokens(text), {}
        for i, diagonal in self.hits(t):
            q = self.tokens[i]
            a, b = max(0, -diagonal), min(len(q), len(t) - diagonal)
            same = q[a:b] == t[a + diagonal : b + diagonal]
            n, length, start = stretch(same)
            if n >= self.need[i]:
                x = (-n, length, a + diagonal + start)
                key = self.ids[i]
                best[key] = min(best.get(key, x), x)
        return [(k, -n, length, start) for k, (n, length, start) in sorted(best.items(), key=lambda e: (e[0] is None, e[0]))]


def stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(equal tokens, length, start) of the stretch of greatest score; the first of equal ones."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(total[: end + 1].argmin())
    return int(same[start:end].sum()), end - start, start


def blocks(items: DataFrame, item_id: str, text: str, block_mb: int) -> list[list[tuple]]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    own = items.select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null").distinct()
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // (block_mb << 20)))
    while n > 1:
        part = own.groupBy(F.pmod(F.xxhash64("i", "t"), F.lit(n)).alias("p")).agg(F.sum(F.octet_length("t")).alias("s"), F.count("*").alias("c"))
        if part.where((F.col("s") > block_mb << 20) & (F.col("c") > 1)).isEmpty():
            break
        n *= 2
    for p in range(n):
        yield [(r.i, bytes(r.t)) for r in own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == p).orderBy("i", "t").collect()]


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", matched: int = 13, block_mb: int = 4) -> DataFrame:
    """A row per contaminated document and item: doc_id, item_id, n_matched, n_aligned, doc_start (in tokens)."""
    rows, spark, out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")), docs.sparkSession, None
    names = ["doc_id", "item_id", "n_matched", "n_aligned", "doc_start"]
    for block in blocks(items.withColumn(item_id, F.col(item_id).cast("long")), item_id, item_text, block_mb):
        shared = spark.sparkContext.broadcast(Index(block, matched))

        def run(batches, shared=shared):
            for b in batches:
                got = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in shared.value.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(5)], names=names)

        part = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", matched: int = 13, block_mb: int = 4) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns."""
    for block in blocks(items, item_id, item_text, block_mb):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, matched))
        docs = filtered(docs, text, lambda texts, shared=shared: [t is None or not shared.value.find(t.encode("utf-8", "surrogatepass")) for t in texts])
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
