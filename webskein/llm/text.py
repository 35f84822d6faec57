"""Words, their hashes and shingle sets of whole texts, vectorised over a text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes' own methods have exactly these two rules."""
    return text.lower().split()


def hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes; all of them as one, where there are fewer."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = out * M2 + h[i : i + n] * GOLD
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    return np.unique(rolled(hashes(words(text or b"")), width))


def text_keys(text: Column) -> list[Column]:
    """128 bits of a text, by which a later plan finds its row again."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, or longer ones that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def small(batches: Iterable[pa.RecordBatch], at: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts, in column ``at``, have about ``size`` bytes, or of a single longer one, so that all that is made of a batch at once stays small. Nothing is copied."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield b.slice(start, stop - start)
            start = stop


def filtered(docs: DataFrame, text: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``docs`` that ``keep`` chooses by their texts, a batch at a time, with all columns; these go by place, so that any names will do."""
    at = docs.columns.index(text)

    def run(batches):
        for b in small(batches, at):
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
