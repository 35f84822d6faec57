"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its 5-word shingles. In each of ``trees`` independent trees it branches from node to node by minwise tokens: a node's path picks which of the document's tokens leads on, and documents with the
same token stay together. A node of at most ``block`` members is compared exhaustively at the depth where it becomes that small; larger ones branch further, to ``depth`` at most, where they are
compared block by block. Candidates pass sizes, a 64-bit sketch (one bit of each minwise token) and then the agreement of 64 bytes (one byte of each), and are confirmed on full
sets, in two turns: first a forest (each member with its closest one), then, after components are known, all remaining pairs whose ends lie in different components. So no pair within a group of copies
is confirmed more often than needed, and none that could join two groups is left out.

Equal sets, found by size and a 128-bit hash, are one class from the start; all links are between classes. Trees and sketches follow ``percent``: for a pair at similarity 0.85 a tree of
depth 3 meets with 0.61 at least, 16 trees with 1 - 3e-7; 16 sketch bits may differ and 39 bytes must agree; at 0.80 a tree meets with 0.51, 21 trees with 1 - 3e-7; 19 bits may differ and 35 bytes must agree.

Defined results. A null or wordless text is an empty set: linked with nothing, component its own id. Each input row gives one row.
A null id is linked with nothing. Rows that repeat an id with another text are linked by their own texts. An empty table gives no rows. Very long texts are read whole; a task holds one
text and its set at a time. Only the two named columns are read.

Scale. Texts are read once for sketches and again only for documents that a confirmation needs. Nodes are streamed from sorted partitions: a task holds one block of ``block`` members. A hot node is cut into blocks that
meet pairwise, where members of the node's commonest component are never held against each other. Sets move only for candidates. Each intermediate table is freed after its last reader.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webskein.llm.graph import components
from webskein.llm.text import GOLD, M2, mix, shingles, text_keys, unused
from webskein.plans.staging import free, stage

K = 64  # minwise tokens
MISSED_MEETING, MISSED_SKETCH = 3e-7, 5e-6  # of pairs just at the threshold, at most
BROADCAST_ROWS = 1_000_000
SALTS = 8
WIDE = 8  # blocks of ``lone`` are so many times larger, which move less often

_SEEDS = mix(np.arange(1, K + 1, dtype=np.uint64) * GOLD) | np.uint64(1)


@cache
def far_for(percent: int) -> int:
    """Sketch bits in which a link may differ. A minwise token differs with 1 - similarity, its bit with half of that."""
    p = (100 - percent) / 200
    return next(f for f in range(K + 1) if sum(comb(K, i) * p**i * (1 - p) ** (K - i) for i in range(f + 1, K + 1)) <= MISSED_SKETCH)


@cache
def agreeing_for(percent: int) -> int:
    """Bytes of minwise tokens in which a link must agree."""
    p = percent / 100
    return max(a for a in range(K + 1) if sum(comb(K, i) * p**i * (1 - p) ** (K - i) for i in range(a)) <= MISSED_SKETCH)


def trees_for(percent: int, depth: int) -> int:
    """Trees so that a pair at the threshold meets in one of them."""
    trees, apart = 1, 1 - (percent / 100) ** depth
    while apart**trees > MISSED_MEETING:
        trees += 1
    return trees


def minwise(s: np.ndarray) -> np.ndarray:
    """K minwise tokens (32 bits of each) of a non-empty set of hashes. Tables hold them by bytes: the lowest of all tokens come first."""
    out = np.full(K, np.uint32(0xFFFFFFFF))
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        for k in range(K):
            out[k] = min(out[k], int((part * _SEEDS[k]).min()) >> 32)
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(int(mix(s ^ x).sum(dtype=np.uint64).view(np.int64)) for x in (np.uint64(0), M2))


def _sketch(batches):
    names = ["row_id", "doc_id", "k1", "k2", "n_shingles", "h1", "h2", "bits", "mins"]
    for b in batches:
        n, h, bits, mins = [], [], [], []
        for t in b.column(4):
            s = shingles(t.as_py())
            n.append(len(s))
            if len(s):
                m = minwise(s)
                h.append(set_hash(s))
                bits.append(int(np.packbits(((m * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).view(np.int64)[0]))
                mins.append(m.view(np.uint8).reshape(K, 4).T.tobytes())
            else:
                h.append((None, None)), bits.append(None), mins.append(None)
        found = [n, [x[0] for x in h], [x[1] for x in h], bits]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(x, pa.int64()) for x in found), pa.array(mins, pa.binary())], names=names)


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), *text_keys(F.col(text)), F.col(text).cast("binary").alias("t"))
    return stage(rows.mapInArrow(_sketch, "row_id long, doc_id long, k1 long, k2 long, n_shingles long, h1 long, h2 long, bits long, mins binary"), "sketches")


def steps(classes: DataFrame, trees: int, depth: int, keep: tuple[str, ...]) -> DataFrame:
    """(key1 .. key ``depth``, keep's columns) for every class and tree: the nodes on its path. A node's path picks the token."""
    keys = [f"key{d}" for d in range(1, depth + 1)]

    def walk(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c = dict(zip(b.schema.names, b.columns))
            m = np.ascontiguousarray(np.frombuffer(b"".join(c["mins"].to_pylist()), np.uint8).reshape(-1, 4, K).transpose(0, 2, 1)).view(np.uint32)[:, :, 0].astype(np.uint64)
            at = np.arange(len(m))
            for t in range(trees):
                path, on = np.full(len(m), mix(np.array([t + 1], np.uint64) * GOLD)[0]), []
                for _ in range(depth):
                    pick = (mix(path) % np.uint64(K)).astype(np.int64)
                    path = mix(path ^ (m[at, pick] * GOLD + pick.astype(np.uint64)))
                    on.append(pa.array(path.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*on, *(c[x] for x in keep)], names=[*keys, *keep])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    return classes.select("mins", *keep).mapInArrow(walk, ", ".join([f"{k} long" for k in keys] + [f"{x} {kinds[x]}" for x in keep]))


def bounded(keys: DataFrame) -> DataFrame:
    """Staged keys of 8 bytes: broadcast up to a counted bound; beyond it the planner joins by shuffling."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def large_nodes(classes: DataFrame, trees: int, depth: int, block: int) -> list[DataFrame]:
    """For each depth the nodes there (key) that have more than ``block`` members and aren't below a smaller one."""
    found = []
    for d in range(1, depth + 1):
        rows = steps(classes, trees, d, ())
        if d > 1:
            rows = rows.join(bounded(found[-1].withColumnRenamed("key", f"key{d - 1}")), f"key{d - 1}", "left_semi")
        found.append(stage(rows.groupBy(F.col(f"key{d}").alias("key")).count().where(F.col("count") > block).select("key"), f"large{d}"))
        if found[-1].isEmpty():
            break
    return found


def nodes(classes: DataFrame, trees: int, depth: int, large: list[DataFrame], keep: tuple[str, ...]) -> DataFrame:
    """(key, keep's columns): every class with the node of each tree where its branching ends: the first small one on its path, or that at ``depth``."""
    rows = steps(classes, trees, depth, keep)
    key = F.col(f"key{depth}")
    for d in range(min(depth - 1, len(large)), 0, -1):
        # with large[d - 1] empty, all paths end at depth d
        key = F.when(F.col(f"big{d}").isNull(), F.col(f"key{d}")).otherwise(key)
        rows = rows.join(bounded(large[d - 1]).select(F.col("key").alias(f"key{d}"), F.lit(True).alias(f"big{d}")), f"key{d}", "left")
    return rows.select(key.alias("key"), *keep)


def _differing(b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Sketch bits in which each two differ; of unsigned numbers, as the count of a negative one is that of its absolute value."""
    return np.bitwise_count((b1[:, None] ^ b2[None, :]).view(np.uint64))


def _passing(n1, b1, n2, b2, percent: int) -> np.ndarray:
    """Which pairs of a block may be links, by size and sketch."""
    small, large = np.minimum(n1[:, None], n2[None, :]), np.maximum(n1[:, None], n2[None, :])
    return (_differing(b1, b2) <= far_for(percent)) & (100 * small >= percent * large)


def _runs(batches, columns: list[str]):
    """Arrays of the rows of one key after the other, in pieces: (piece of a key's rows, whether it starts the key). Input is sorted by key."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        arrays = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        key = arrays[0]
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        lone = ends - starts == 1
        lone[0] = lone[-1] = False  # they may go on in another batch
        for s, e in zip(starts[~lone], ends[~lone]):
            yield [a[s:e] for a in arrays], key[s] != last
            last = key[s]
        last = key[-1]


def forest(nodes: DataFrame, percent: int, block: int) -> DataFrame:
    """Candidate pairs (a, b): each member with the closest of those that it is held against: earlier ones of its nodes (of a larger node the first ``block`` and its own piece)."""

    def link(batches):
        held: list[np.ndarray] = []
        for (_, node, n, bits), new in _runs(batches, ["key", "node", "n", "bits"]):
            out = []
            for at in range(0, len(node), block):
                p = [x[at : at + block] for x in (node, n, bits)]
                if new and not at:
                    held = [x[:0] for x in p]
                both = [np.concatenate([x, y]) for x, y in zip(held, p)]
                ok = _passing(p[1], p[2], both[1], both[2], percent)
                ok &= np.arange(len(both[0]))[None, :] < (len(held[0]) + np.arange(len(p[0])))[:, None]
                ok &= p[0][:, None] != both[0][None, :]
                some = ok.any(1)
                if some.any():
                    far = np.where(ok, _differing(p[2], both[2]), 255)[some]
                    out.append((p[0][some], both[0][far.argmin(1)], far.min(1)))
                if len(held[0]) < block:
                    held = [x[:block] for x in both]
            if out:
                a, b, far = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(far.astype(np.int32))], names=["node", "other", "far"])

    return closest(nodes.repartition("key").sortWithinPartitions("key", "node").mapInArrow(link, "node long, other long, far int"))


def closest(found: DataFrame) -> DataFrame:
    """(a, b): each node with the other one that differs in the fewest bits."""
    best = found.groupBy("node").agg(F.min(F.struct("far", "other"))["other"].alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def lone(nodes: DataFrame, active: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): each member of ``nodes`` (key, node, n, bits) that isn't in ``active`` (node) with the closest one of all nodes that it is in.

    Members are put in blocks by size, and only blocks of which some sizes may link meet."""

    def packed(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("key").orderBy("n", "node"))
        blocks = rows.withColumn("part", F.floor((place - 1) / (WIDE * block))).groupBy("key", "part")
        return blocks.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.collect_list(F.struct("node", "n", "bits")).alias("x"))

    asking = stage(packed(nodes.join(active, "node", "left_anti").select("key", "node", "n", "bits")), "asking")
    asked = stage(packed(nodes.join(asking.select("key").distinct(), "key", "left_semi")), "asked")
    one, two = asking.select("key", F.col("part").alias("i"), "lo", "hi", F.col("x").alias("xi")), asked.select("key", F.col("part").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("x").alias("xj"))
    like = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    met = one.drop("xi").join(two.drop("xj"), "key").where(like).select("key", "i", "j")
    met = met.join(one.select("key", "i", "xi"), ["key", "i"]).join(two.select("key", "j", "xj"), ["key", "j"]).select("xi", "xj")

    def link(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = ([c.values.field(k).to_numpy(zero_copy_only=False) for k in range(3)] for c in (batch.column(0)[r], batch.column(1)[r]))
                for at in range(0, len(x[0]), block):
                    p = [v[at : at + block] for v in x]
                    ok = _passing(p[1], p[2], y[1], y[2], percent) & (p[0][:, None] != y[0][None, :])
                    some = ok.any(1)
                    if some.any():
                        far = np.where(ok, _differing(p[2], y[2]), 255)[some]
                        yield pa.RecordBatch.from_arrays([pa.array(p[0][some]), pa.array(y[0][far.argmin(1)]), pa.array(far.min(1).astype(np.int32))], names=["node", "other", "far"])

    return closest(met.mapInArrow(link, "node long, other long, far int"))


def crossing(nodes: DataFrame, percent: int, block: int) -> DataFrame:
    """All candidate pairs of a node whose ends lie in different components. nodes: key, node, n, bits, low, comp.

    Nodes of one component have none. In others the members of the commonest component come last, and blocks of them meet only blocks of the rest: where m - r of m members are of
    one component, r * m pairs are compared, in blocks of about ``block`` members by hash, of which each two that may hold a pair meet once."""
    of = nodes.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    size = of.select("key", F.col("most.comp").alias("common"), F.ceil((F.col("m") - F.col("most.m")) / block).cast("int").alias("rest"), F.ceil(F.col("most.m") / block).cast("int").alias("same"))
    mixed = nodes.join(size, "key").withColumn("common", F.col("comp") == F.col("common"))
    mixed = mixed.withColumn("part", F.when(F.col("common"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("same"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int"))
    # the block pair (i, j), i <= j, i < rest, is named by both
    met = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("common"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("same") - 1))))
    met = met.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "bits", "low", "comp")
    tagged = met.withColumn("pair", F.xxhash64("key", "i", "j"))
    agree = agreeing_for(percent)

    def link(batches):
        kept: list[np.ndarray] = []

        def pairs(x):
            i, j, part, node, n, bits, low, comp = x
            first, second = part == i, part == j
            a, b = [y[first] for y in (node, n, bits, comp, low)], [y[second] for y in (node, n, bits, comp, low)]
            ok = _passing(a[1], a[2], b[1], b[2], percent) & (a[3][:, None] != b[3][None, :])
            u, v = np.nonzero(ok)
            if len(u):
                left, right = (np.frombuffer(b"".join(y[4]), np.uint8).reshape(-1, K) for y in (a, b))
                same = np.concatenate([(left[u[k : k + 65536]] == right[v[k : k + 65536]]).sum(1) for k in range(0, len(u), 65536)]) >= agree
                u, v = u[same], v[same]
            u, v = a[0][u], b[0][v]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

        for (_, *x), new in _runs(batches, ["pair", "i", "j", "part", "node", "n", "bits", "low", "comp"]):
            if new and kept:
                yield pairs(kept)
            kept = x if new else [np.concatenate(y) for y in zip(kept, x)]
        if kept:
            yield pairs(kept)

    return tagged.repartition("pair").sortWithinPartitions("pair", "node").mapInArrow(link, "a long, b long").distinct()


def agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose minwise tokens agree in enough bytes. classes: node, low."""
    agree = agreeing_for(percent)

    def judge(batches):
        for b in batches:
            left, right = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, K) for c in b.columns[2:])
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array((left == right).sum(1) >= agree))

    one, two = classes.select(F.col("node").alias("a"), F.col("low").alias("x")), classes.select(F.col("node").alias("b"), F.col("low").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def sets_of(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, s): the full sets of the classes ``wanted`` (node, first, k1, k2), read anew from their first row's text."""

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["node", "s"])

    texts = docs.select(F.col(doc_id).cast("long").alias("first"), *text_keys(F.col(text)), F.col(text).cast("binary").alias("t")).where(F.col("t").isNotNull())
    found = texts.join(bounded(wanted), ["first", "k1", "k2"]).select("node", "t").mapInArrow(read, "node long, s binary")
    return stage(found.groupBy("node").agg(F.first("s").alias("s")), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, link) by the full sets: 100 * intersection >= percent * union."""

    def judge(batches):
        for b in batches:
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                i = np.searchsorted(large, small)
                i[i == len(large)] = 0
                both = int((large[i] == small).sum())
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], names=["a", "b", "link"])

    one, two = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long, link boolean")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, trees: int | None = None, depth: int = 3, block: int = 512) -> DataFrame:
    """Per input row: row_id, doc_id, k1 and k2 (a hash of the text), n_shingles, component_id, kept. ``trees``: as many as ``percent`` needs, if None."""
    trees = trees_for(percent, depth) if trees is None else trees
    sketched = sketches(docs, doc_id, text)
    by_set = ["n_shingles", "h1", "h2"]
    rest = F.struct("row_id", "doc_id", "k1", "k2", "bits", "mins")
    first = F.min_by(rest, F.struct("doc_id", "row_id"))
    named = sketched.where("h1 is not null and doc_id is not null").groupBy(*by_set).agg(first.alias("x"), F.count("*").alias("size"))
    classes = stage(named.select(F.col("x.row_id").alias("node"), *by_set, F.col("x.doc_id").alias("first"), "size", "x.k1", "x.k2", F.col("n_shingles").alias("n"), "x.bits", "x.mins", F.substring("x.mins", 1, K).alias("low")), "classes")
    rows = stage(sketched.select("row_id", "doc_id", "k1", "k2", *by_set), "rows")
    free(sketched)
    large = large_nodes(classes, trees, depth, block)
    near = stage(forest(nodes(classes, trees, depth, large, ("node", "n", "bits")), percent, block), "near")
    if len(large) == depth and not large[-1].isEmpty():
        members = stage(nodes(classes, trees, depth, large, ("node", "n", "bits")).join(bounded(large[-1]), "key", "left_semi"), "members")
        more = near.union(lone(members, ends(near), percent, block))
        near, before = stage(more, "near"), near
        free(members, before)
    active = stage(classes.join(bounded(stage(ends(near), "ends")), "node", "left_semi"), "active")
    near, before = stage(agreeing(near, active, percent), "near"), near
    free(before)
    wanted = ("node", "first", "k1", "k2")
    sets = sets_of(docs, doc_id, text, stage(active.join(ends(near), "node", "left_semi").select(*wanted), "wanted"))
    tried = stage(confirm(near, sets, percent), "tried")
    free(near, sets)
    comps = components(tried.where("link").select("a", "b"))
    placed = nodes(active, trees, depth, large, ("node", "n", "bits", "low")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    more = stage(crossing(placed, percent, block).join(tried, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        sets = sets_of(docs, doc_id, text, stage(active.join(ends(more), "node", "left_semi").select(*wanted), "wanted"))
        linked = stage(confirm(more, sets, percent).where("link").select("a", "b").union(tried.where("link").select("a", "b")), "linked")
        free(sets, comps)
        comps = components(linked)
    free(active, tried, more, *large)
    members = classes.join(comps, "node").select("comp", *by_set, "first", "size")
    ids = members.groupBy("comp").agg(F.min("first").alias("component_id"))
    # a class is a component of its own, unless it is linked; a hot class is spread over tasks
    of = members.join(ids, "comp").select(*by_set, "component_id").union(classes.where("size > 1").join(comps, "node", "left_anti").select(*by_set, F.col("first").alias("component_id")))
    of = stage(of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "components")
    free(classes)
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNotNull(), (F.col("row_id") % SALTS).cast("int")))
    out = salted.join(of, [*by_set, "salt"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("row_id", "doc_id", "k1", "k2", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all their columns; of rows that repeat such an id and text, one.

    Rows go by id and text; a repeated id whose texts lie in different components is judged for each text by itself. Of rows that repeat an id and a text but differ in other columns any one stays."""
    columns = docs.columns
    a, b, c = keys = unused(columns, "near_id", "near_k1", "near_k2")
    named = [F.col("doc_id").alias(a), F.col("k1").alias(b), F.col("k2").alias(c)]
    found = stage(near_duplicates(docs, doc_id, text, **how).where("doc_id is not null and n_shingles > 0").select("doc_id", "k1", "k2", "kept"), "found")
    gone = stage(found.where("not kept").select(*named).distinct(), "gone")
    copies = stage(found.where("kept").groupBy("doc_id", "k1", "k2").count().where("count > 1").select(*named), "copies")
    free(found)
    k1, k2 = text_keys(F.col(f"`{text}`"))
    marked = docs.withColumn(a, F.col(f"`{doc_id}`").cast("long")).withColumn(b, k1).withColumn(c, k2)
    out = marked.join(bounded(gone), keys, "left_anti")
    if not copies.isEmpty():
        out = out.join(bounded(copies), keys, "left_anti").union(out.join(bounded(copies), keys, "left_semi").dropDuplicates(keys))
    return out.select(*(F.col(f"`{x}`") for x in columns))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
h AS (SELECT doc_id, md5_number(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
