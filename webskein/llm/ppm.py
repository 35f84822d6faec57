"""Language-model scoring: prediction by partial matching over bytes, beside a word unigram base.

The model is a byte-context trie pretrained on all training documents, with contexts of ``DEEP`` = 4 bytes, and of 2, 1 and none. Symbols are the bytes
of the text with A-Z lower-cased and an end; no UTF-8 text holds 0xFE and 0xFF, so these stand for what is before the start and for the end. A symbol unseen in a context escapes
to the next shorter one, with the escape estimate D / (T + D) (D distinct symbols, T occurrences), where the symbols of the longer context are excluded from the shorter one's counts.
Below order 0 all remaining symbols are equally likely. ``score`` is the log10 probability of the text and its end.

The trie's upper part has at most 2**16 contexts of 2**8 symbols: two tables of 67 MB, which bounds the broadcast whatever the corpus. The contexts of four bytes grow with the corpus, and so do the words of the base
(n_tokens, n_known, train_tokens, base_score); no bound holds for either, and they stay distributed. A task codes its texts in batches of about ``batch_mb`` and writes them with tables of their own: distinct words, grams and contexts.
These tables, not the texts, are joined with the counts over the corpus, and come back to the texts by batch, where symbols find their grams by hashing. A hot word or context is one row for a batch, however often it
occurs; a context's symbols, 256 at most, move as one value.

Defined results. A null text is an empty one: its end is its only token and symbol. Each input row gives one row, repeated ids included. A null id is in
training. Without training tokens N and V are 0: every symbol is equally likely. Very long texts are scored whole; a task holds the batch that ends with one. An empty table gives no rows. Only the two named columns are read. Words are
counted by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from webskein.llm.text import GOLD, hashes, words
from webskein.plans.staging import free, stage, stage_by

END_WORD = np.uint64(xxh3_64_intdigest(b"\xff"))  # no word has this byte
START, END = 0xFE, 0xFF
DEEP = 4
LISTS = "kind int, batch long, doc_id array<long>, held_out array<boolean>, n_tokens array<int>"
#: By kind of row: a batch's texts, its tables, its counts.
TEXTS, TABLES, COUNTS = ("symbols", "tokens"), ("words", "contexts"), ("word", "word_counts", "grams", "gram_counts", "short", "short_counts")
CODED = ", ".join([LISTS, *(f"{x} binary" for x in (*TEXTS, *TABLES, *COUNTS))])
STEP = 1 << 19


def is_held_out(doc_id: int | None, parts: int, rest: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == rest


def wrapped(text: bytes) -> bytes:
    return bytes((START,)) * DEEP + text.lower() + bytes((END,))


def grams(a: np.ndarray) -> np.ndarray:
    """Each symbol with the DEEP ones before it, 40 bits, from the first that has so many. a: texts as wrapped() gives them, joined."""
    out = np.zeros(len(a) - DEEP, np.int64)
    for i in range(DEEP + 1):
        out <<= 8
        out |= a[i : i + len(out)]
    return out


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their counts' sums."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def counted(a: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the symbols to keep, with their counts; a bounded piece at a time."""
    parts = [np.unique(grams(a[at : at + STEP + DEEP])[keep[at : at + STEP]], return_counts=True) for at in range(0, len(a) - DEEP, STEP)]
    return summed(*(np.concatenate(x) for x in zip(*parts)))


def squeezed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def opened(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _coder(parts: int, rest: int, batch_mb: int):
    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * len((*TEXTS, *TABLES, *COUNTS))]
    names = [x.split()[0] for x in CODED.split(", ")]

    def row(**values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in zip(names, types)], names=names)

    def run(batches):
        first, k, size = TaskContext.get().partitionId() << 32, 0, 0
        ids, held, lengths, coded, texts = [], [], [], [], []

        def flush():
            nonlocal k, size
            learned, sizes = ~np.array(held, bool), [len(t) for t in texts]
            hashed = np.concatenate(coded)
            coded.clear()
            table, tokens = np.unique(hashed, return_inverse=True)
            del hashed
            counts = np.bincount(tokens[np.repeat(learned, lengths)], minlength=len(table))
            tokens = squeezed(tokens.astype("<u4"))
            a = np.frombuffer(b"".join(texts), np.uint8)
            texts.clear()
            symbol, of = a[DEEP:] != START, np.repeat(learned, sizes)[DEEP:]
            code, n = counted(a, symbol & of)
            contexts = np.unique(np.concatenate([code >> 8, counted(a, symbol & ~of)[0] >> 8]))
            short, m = summed(code & 0xFFFFFF, n)
            packed = lambda x: x.astype("<i8").tobytes()
            yield row(kind=0, batch=first + k, doc_id=list(ids), held_out=list(held), n_tokens=list(lengths), symbols=squeezed(a), tokens=tokens)
            yield row(kind=1, batch=first + k, words=table.tobytes(), contexts=packed(contexts))
            seen = counts > 0
            yield row(kind=2, word=table[seen].tobytes(), word_counts=packed(counts[seen]), grams=packed(code), gram_counts=packed(n), short=packed(short), short_counts=packed(m))
            k, size = k + 1, 0
            for x in (ids, held, lengths):
                x.clear()

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or b""
                ids.append(i), coded.append(np.append(hashes(words(t)), END_WORD)), texts.append(wrapped(t))
                lengths.append(len(coded[-1])), held.append(is_held_out(i, parts, rest))
                size += len(t) + 64
                if size > batch_mb << 20:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _rows(schema: str, numbered: bool = False):
    """Rows of packed columns; with the batch and each row's number before them."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns)):
                packed = [np.frombuffer(v, np.int64) for v in values[numbered:]]
                for at in range(0, len(packed[0]), 1 << 17):
                    cols = [x[at : at + (1 << 17)] for x in packed]
                    if numbered:
                        cols = [np.full(len(cols[0]), values[0]), np.arange(at, at + len(cols[0])), *cols]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return run


def _contexts(batches):
    """(context, dist) of grams in order: a context's symbols, as a byte each, then their counts, as four."""
    rest = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def packed(code, n):
        n = n.astype("<f4")
        ctx, at = np.unique(code >> 8, return_index=True)
        symbol, ends = (code & 0xFF).astype(np.uint8), [*at[1:], len(code)]
        return pa.RecordBatch.from_arrays([pa.array(ctx), pa.array([symbol[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())], names=["ctx", "dist"])

    for b in batches:
        if not b.num_rows:
            continue
        code, n = (np.concatenate([x, c.to_numpy()]) for x, c in zip(rest, b.columns))
        code, n = summed(code, n)
        cut = int(np.searchsorted(code, code[-1] >> 8 << 8))  # the last context may go on
        if cut:
            yield packed(code[:cut], n[:cut])
        rest = code[cut:], n[cut:]
    if len(rest[0]):
        yield packed(*rest)


class Trie:
    """The trie's upper part, contexts of up to two bytes: log10 probabilities and counts, a row of 256 for each context seen, and for each last byte."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        code, count = code.astype(np.int64), count.astype(np.float64)
        two = np.bincount(code & 0xFFFF, weights=count, minlength=1 << 16).reshape(256, 256)
        one = two.sum(0)
        total, kinds = one.sum(), int((one > 0).sum())
        rest = 256 - kinds
        # order 0 by what is excluded: the symbols seen after the last byte
        self.row = np.repeat(np.arange(256, dtype=np.int32)[None, :], 256, 0).reshape(-1)  # context -> row; unseen: that of its last byte
        rows, numbers = [np.zeros((256, 256), np.float32)], [np.zeros((256, 256), np.float32)]
        order = np.argsort(code >> 8 & 0xFF, kind="stable")
        code, count = code[order], count[order]
        bounds = np.searchsorted(code >> 8 & 0xFF, np.arange(257))
        n = 256
        for last in range(256):
            c2 = two[last]
            seen2 = c2 > 0
            t0, d0 = one[~seen2].sum(), int((one > 0).sum() - seen2.sum())
            zero = self._escaped(one, np.array([t0 if seen2.any() else total]), np.array([d0 if seen2.any() else kinds]), np.full(256, 1.0 / max(rest, 1)), ~seen2)[0]
            t2, d2 = c2.sum(), int(seen2.sum())
            first = self._escaped(c2, np.array([t2]), np.array([d2]), zero, np.ones(256, bool))[0] if d2 else zero
            rows[0][last] = np.log10(np.maximum(first, 1e-300))
            s = slice(bounds[last], bounds[last + 1])
            if s.start == s.stop:
                continue
            before, at = np.unique(code[s] >> 16, return_inverse=True)
            c3 = np.zeros((len(before), 256))
            c3[at, code[s] & 0xFF] = count[s]
            seen3 = c3 > 0
            d3 = seen3.sum(1)
            lower = self._escaped(np.broadcast_to(c2, c3.shape), (c2 * ~seen3).sum(1), d2 - d3, np.broadcast_to(zero, c3.shape), ~seen3)
            t3 = c3.sum(1)
            p = np.where(seen3, c3 / (t3 + d3)[:, None], (d3 / (t3 + d3))[:, None] * lower)
            rows.append(np.log10(np.maximum(p, 1e-300)).astype(np.float32))
            numbers.append(c3.astype(np.float32))
            self.row[before << 8 | last] = n + np.arange(len(before))
            n += len(before)
        self.table, counts = np.concatenate(rows).reshape(-1), np.concatenate(numbers)
        self.total, self.kinds, self.counts = counts.sum(1, dtype=np.float64), (counts > 0).sum(1), counts.reshape(-1)

    @staticmethod
    def _escaped(counts: np.ndarray, total: np.ndarray, kinds: np.ndarray, below: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Probabilities at a node: of its symbols that aren't excluded, and through the escape of all others."""
        all_ = np.maximum(total + kinds, 1e-300)[:, None]
        escape = np.where(total + kinds > 0, kinds / np.maximum(total + kinds, 1e-300), 1.0)[:, None]
        counts = np.atleast_2d(counts)
        return np.where((counts > 0) & open_, counts / all_, escape * below)


class Places:
    """Where each of some distinct codes stands, found by hashing."""

    def __init__(self, codes: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(codes)).bit_length()))
        h = self.hashed(codes)
        self.order = np.argsort(h, kind="stable")
        self.codes, self.start = codes[self.order], np.concatenate([[0], np.cumsum(np.bincount(h, minlength=1 << (64 - int(self.shift))))]).astype(np.int32)

    def hashed(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * GOLD) >> self.shift).astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = self.start.take(self.hashed(codes))
        first = np.minimum(at, len(self.codes) - 1)
        hit = self.codes.take(first) == codes
        out = np.where(hit, self.order.take(first), -1)
        left = np.flatnonzero(~hit)
        at, end = at[left] + 1, self.start.take(self.hashed(codes[left]) + 1)
        while len(left):
            go = at < end
            left, at, end = left[go], at[go], end[go]
            hit = self.codes.take(at) == codes[left]
            out[left[hit]] = self.order.take(at[hit])
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return out


class Deep:
    """The contexts of four bytes that a batch needs, over the upper trie."""

    def __init__(self, trie: Trie, ctx: np.ndarray, dist: pa.BinaryArray):
        ends = np.frombuffer(dist.buffers()[1], np.int32)[dist.offset : dist.offset + len(dist) + 1].astype(np.int64) if len(dist) else np.zeros(1, np.int64)
        data = np.frombuffer(dist.buffers()[2], np.uint8) if len(dist) else np.zeros(0, np.uint8)
        self.trie, kinds = trie, np.diff(ends) // 5
        self.owner, first = np.repeat(np.arange(len(ctx)), kinds), np.cumsum(kinds) - kinds
        place = np.arange(len(self.owner)) - first[self.owner]
        self.symbols = data[ends[self.owner] + place]
        at = ends[self.owner] + kinds[self.owner] + 4 * place
        self.n = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<f4")[:, 0].astype(np.float64)
        row = trie.row.take(ctx & 0xFFFF).astype(np.int64)
        shorter = trie.counts.take(row.repeat(kinds) * 256 + self.symbols).astype(np.float64)
        add = lambda x: np.add.reduceat(x, first) if len(ctx) else x
        self.all = add(self.n) + kinds
        # what the shorter context keeps, when this one's symbols are excluded
        self.kinds, self.kept_kinds, self.kept = kinds, trie.kinds[row] - kinds, trie.total[row] - add(shorter)
        self.log = np.log10(self.n / self.all[self.owner])
        self.contexts, self.grams = Places(ctx), Places(ctx.repeat(kinds) << 8 | self.symbols)

    def log10(self, g: np.ndarray) -> np.ndarray:
        """Of each gram's last symbol after the others."""
        trie, at = self.trie, self.grams.of(g)
        out = self.log.take(at) if len(self.log) else np.zeros(len(g))
        miss = np.flatnonzero(at < 0)
        row, symbol = trie.row.take(g[miss] >> 8 & 0xFFFF).astype(np.int64), g[miss] & 0xFF
        lower = trie.table.take(row * 256 + symbol).astype(np.float64)
        ctx = self.contexts.of(g[miss] >> 8)
        known = np.flatnonzero(ctx >= 0)
        ctx, row, symbol = ctx[known], row[known], symbol[known]
        n, kinds, kept = trie.counts.take(row * 256 + symbol), self.kept_kinds[ctx], self.kept[ctx]
        all_, below = np.maximum(kept + kinds, 1e-300), lower[known] + np.log10((trie.total[row] + trie.kinds[row]) / np.maximum(trie.kinds[row], 1))
        lower[known] = np.log10(self.kinds[ctx] / self.all[ctx]) + np.where(n > 0, np.log10(np.maximum(n, 1e-300) / all_), below + np.log10(np.where(kinds > 0, kinds / all_, 1.0)))
        out[miss] = lower
        return out

    def scores(self, a: np.ndarray) -> np.ndarray:
        """The sum for each text of a batch."""
        ends = np.flatnonzero(a == END)
        out = np.zeros(len(ends))
        for at in range(0, len(a) - DEEP, STEP):
            part = a[at : at + STEP + DEEP]
            symbol = np.flatnonzero(part[DEEP:] != START)
            p = self.log10(grams(part)[symbol])
            out += np.bincount(np.searchsorted(ends, symbol + at + DEEP), weights=p, minlength=len(ends))
        return out


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, rest: int = 2, batch_mb: int = 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from documents whose crc32(id) mod ``parts`` isn't ``rest``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    texts, tables, found = stage_by(rows.mapInArrow(_coder(parts, rest, batch_mb), CODED), "kind", range(3), "coded")
    # the upper trie: at most 2**24 codes
    pairs = lambda x, y, name: found.select(x, y).mapInArrow(_rows(f"{name} long, n long"), f"{name} long, n long")
    upper = pairs("short", "short_counts", "code").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    trie = spark.sparkContext.broadcast(Trie(upper["code"].to_numpy(), upper["n"].to_numpy()))
    deep = pairs("grams", "gram_counts", "code").repartition(F.shiftright("code", 8)).sortWithinPartitions("code").mapInArrow(_contexts, "ctx long, dist binary")
    deep = stage(deep, "contexts")
    counts = stage(pairs("word", "word_counts", "word").groupBy("word").agg(F.sum("n").alias("c")), "words")
    free(found)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the batches' own tables with the corpus's counts
    asked = lambda column, name: tables.select("batch", column).mapInArrow(_rows(f"batch long, k long, {name} long", True), f"batch long, k long, {name} long")
    known = asked("words", "word").join(counts, "word").select("batch", F.col("k").alias("key"), "c", F.lit(None).cast("binary").alias("dist"))
    known = stage(known.union(asked("contexts", "ctx").join(deep, "ctx").select("batch", F.col("ctx").alias("key"), F.lit(None).cast("long").alias("c"), "dist")), "known")
    free(tables, deep, counts)
    out = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        x = {n: left[n][0].as_py() for n in left.column_names}
        is_word = right["dist"].is_null().to_numpy()
        key = right["key"].to_numpy()
        lengths, token = np.array(x["n_tokens"], np.int64), opened(x["tokens"], "<u4")
        c = np.zeros(int(token.max()) + 1, np.int64)
        c[key[is_word]] = right["c"].drop_null().to_numpy()
        at = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10(c + 1.0)[token], at) - lengths * np.log10(n + (v + 1.0))
        seen = np.add.reduceat((c > 0).astype(np.int64)[token], at)
        model = Deep(trie.value, key[~is_word], right["dist"].drop_null().combine_chunks())
        values = [pa.array(x["doc_id"], pa.int64()), pa.array(x["held_out"], pa.bool_()), pa.array(lengths), pa.array(seen), pa.array(base), pa.array(model.scores(opened(x["symbols"], np.uint8)))]
        return pa.Table.from_arrays(values, names=out)

    slim = texts.select("batch", "doc_id", "held_out", "n_tokens", "symbols", "tokens")
    scored = slim.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
