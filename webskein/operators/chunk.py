"""Heading-aware chunk packing of ordered blocks: sections, segments, greedy packing, overlap, rendering and ids.

Each document's blocks are one row's array; packing folds over lengths and positions and builds each body once with slice and join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webskein.functions.text import digest, overlap_suffix, sentences, slices, token_estimate

#: Columns of blocks: document_id, pos, kind, text, heading_path (array<string>).


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 1200
    hard: int = 1600
    overlap: int = 160

    def __post_init__(self):
        if not 0 < self.target <= self.hard or not 0 <= self.overlap < self.target:
            raise ValueError("0 < target <= hard and 0 <= overlap < target are needed")


def sections(blocks: DataFrame) -> DataFrame:
    """Body blocks with ``section``: a new one wherever the heading path differs from the block before, so that a path that comes back is a section of its own."""
    clean = F.when(F.col("kind") == "code", F.regexp_replace("text", r"^\n+|\n+$", "")).otherwise(F.regexp_replace("text", r"^\s+|\s+$", ""))
    body = blocks.withColumn("text", clean).where((F.col("kind") != "heading") & (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    w = W.partitionBy("document_id").orderBy("pos")
    new = F.coalesce(~F.col("heading_path").eqNullSafe(F.lag("heading_path").over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    return body.withColumn("section", F.sum(new.cast("int")).over(w))


def packed(units: Column, limit: int, gap: int, head: Column | int = 0, hard: int = 0) -> Column:
    """Greedy packing: array of (at, n) runs of units whose joined length, with ``gap`` between, stays within ``limit``.

    ``head`` counts too, unless the whole would then exceed ``hard``. A unit that is too long is a run of its own."""
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("size"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))

    def close(acc):
        return F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), acc["n"].alias("n"))))

    def add(acc, u):
        size = acc["size"] + F.when(acc["n"] > 0, gap).otherwise(0) + F.length(u)
        shown = F.when((F.lit(head) > 0) & (size + head <= hard), size + head).otherwise(size)
        fits = (acc["n"] == 0) | (shown <= limit)
        return F.struct(
            F.when(fits, acc["at"]).otherwise(acc["at"] + acc["n"]).cast("int").alias("at"), F.when(fits, acc["n"] + 1).otherwise(1).cast("int").alias("n"), F.when(fits, size).otherwise(F.length(u)).cast("int").alias("size"),
            F.when(fits, acc["out"]).otherwise(close(acc)).alias("out"),
        )

    return F.aggregate(units, start, add, lambda acc: F.when(acc["n"] > 0, close(acc)).otherwise(acc["out"]))


def joined(units: Column, runs: Column, gap: str) -> Column:
    return F.transform(runs, lambda r: F.array_join(F.slice(units, r["at"], r["n"]), gap))


def segments(kind: Column, text: Column, hard: int) -> Column:
    """Pieces of a block, each within ``hard``: whole if it fits, else code by lines and prose by sentences, words and characters, packed up to ``hard``."""
    cut = lambda xs: F.flatten(F.transform(xs, lambda x: F.when(F.length(x) > hard, slices(x, hard)).otherwise(F.array(x))))
    by_words = lambda s: F.filter(cut(F.split(s, r"\s+")), lambda w: w != "")
    units = F.flatten(F.transform(sentences(text), lambda s: F.when(F.length(s) <= hard, F.array(s)).otherwise(joined(by_words(s), packed(by_words(s), hard, 1), " "))))
    prose = joined(units, packed(units, hard, 1), " ")
    # a line that is too long stands alone, whatever its last slice would leave room for
    runs = F.flatten(F.transform(_stretches(F.split(text, "\n"), hard), lambda xs: F.when(F.length(F.get(xs, F.lit(0))) > hard, slices(F.get(xs, F.lit(0)), hard)).otherwise(joined(xs, packed(xs, hard, 1), "\n"))))
    code = F.filter(runs, lambda c: c != "")
    return F.when(F.length(text) <= hard, F.array(text)).when(kind == "code", code).otherwise(prose)


def _stretches(lines: Column, hard: int) -> Column:
    """Lines in stretches: each line that is too long by itself, and the others between them."""
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("now"))
    shut = lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"])

    def add(acc, x):
        long = F.length(x) > hard
        none = F.array().cast("array<string>")
        return F.struct(F.when(long, F.concat(shut(acc), F.array(F.array(x)))).otherwise(acc["out"]).alias("out"), F.when(long, none).otherwise(F.concat(acc["now"], F.array(x))).alias("now"))

    return F.aggregate(lines, start, add, shut)


def rendered(path: Column, body: Column, hard: int) -> Column:
    """Headings above the body, unless that would be too long."""
    full = F.concat_ws("\n\n", F.array_join(path, "\n\n"), body)
    return F.when((F.size(path) > 0) & (F.length(full) <= hard), full).otherwise(body)


def chunks(blocks: DataFrame, documents: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """id, document_id, ordinal, source_url, document_title, heading_path, text, size_chars, estimated_tokens, content_hash.

    documents: document_id, source_url, title. Overlap takes the end of the section's body before, as it was before its own overlap."""
    parts = sections(blocks).select("document_id", "section", "pos", "heading_path", segments(F.col("kind"), F.col("text"), config.hard).alias("parts"))
    by_section = parts.groupBy("document_id", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "parts"))).alias("ps"), F.first("heading_path").alias("path"))
    units = by_section.select("document_id", "section", F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.flatten(F.transform("ps", lambda p: p["parts"])).alias("units"))
    head = F.when(F.size("path") > 0, F.length(F.array_join("path", "\n\n")) + 2).otherwise(0)
    bodies = units.select("*", head.alias("head")).select("document_id", "section", "path", "units", packed(F.col("units"), config.target, 2, F.col("head"), config.hard).alias("runs"))
    rows = bodies.select("document_id", "section", "path", F.posexplode(joined(F.col("units"), F.col("runs"), "\n\n")).alias("n", "body"))
    before = F.lag("body").over(W.partitionBy("document_id", "section").orderBy("n"))
    lead = overlap_suffix(before, config.overlap) if config.overlap else F.lit(None).cast("string")
    longer = F.concat(lead, F.lit("\n\n"), F.col("body"))
    fits = lead.isNotNull() & (lead != "") & (F.length(rendered(F.col("path"), longer, config.hard)) <= config.hard)
    rows = rows.withColumn("text", rendered(F.col("path"), F.when(fits, longer).otherwise(F.col("body")), config.hard))
    rows = rows.withColumn("ordinal", F.row_number().over(W.partitionBy("document_id").orderBy("section", "n")) - 1).join(documents, "document_id")
    nul = F.lit("\0")
    hashed = F.sha2(F.concat(F.coalesce("title", F.lit("")), nul, F.when(F.size("path") > 0, F.concat(F.array_join("path", "\0"), nul)).otherwise(""), F.col("text")).cast("binary"), 256)
    return rows.withColumn("content_hash", hashed).select(
        digest(F.col("document_id"), F.col("ordinal"), F.col("content_hash")).alias("id"), "document_id", "ordinal", "source_url", F.col("title").alias("document_title"), F.col("path").alias("heading_path"), "text",
        F.length("text").alias("size_chars"), token_estimate(F.col("text")).alias("estimated_tokens"), "content_hash",
    )
