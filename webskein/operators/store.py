"""Content-addressed chunk store: five tables, updated as set algebra.

A version is a pointer file that names, for each table, the folders that hold its rows: contents (by content hash), documents (latest by document id), chunks (by chunk hash), content_chunks
(content hash, ordinal, chunk hash), and the log of sessions in the pointers themselves. An update writes a batch's own new rows to folders of its own and then the pointer, so that its cost
follows the batch, readers always see a whole version, and a failed batch leaves nothing behind. Reading takes the latest documents and what they refer to; after ``COMPACT`` batches the
live rows are written anew as one folder for each table.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webskein.plans.staging import free, run_once, stage

DOCUMENTS = "document_id string, url string, canonical_url string, title string, content_hash string, source_bytes long, cleaned_bytes long, source_tokens long, cleaned_tokens long, seq long"
CHUNKS = "chunk_hash string, text string, title string, heading string, n_tokens long"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "content_chunks": "content_hash string, ordinal int, chunk_hash string, seq long", "contents": "content_hash string, text string"}
#: Of pointers. 1: a folder with all tables for each version; 2: folders by table.
VERSION = 2
COMPACT = 8


def latest(documents: DataFrame, key: str = "document_id", order: str = "seq") -> DataFrame:
    """The last row written of each key."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return documents.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upserted(old: DataFrame, new: DataFrame, key: str = "document_id", order: str = "seq") -> DataFrame:
    """``new`` over ``old``: old rows whose key comes again go, so that only the batch is ranked."""
    batch = latest(new, key, order)
    return old.join(batch.select(key), key, "left_anti").unionByName(batch)


def fresh(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of keys that aren't stored, one of each."""
    return batch.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def collisions(batch: DataFrame, key: str, *content: str) -> DataFrame:
    """Keys that stand for more than one content."""
    return batch.groupBy(key).agg(F.count_distinct(F.struct(*content)).alias("n")).where("n > 1")


def live(table: DataFrame, referring: DataFrame, key: str) -> DataFrame:
    return table.join(referring.select(key), key, "left_semi")


def orphans(table: DataFrame, referring: DataFrame, key: str) -> DataFrame:
    return table.join(referring.select(key), key, "left_anti")


def provenance(content_chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_hash, canonical_url, document_id, ordinal: the smallest source of each chunk, in one partial and final aggregate without a sort."""
    each = content_chunks.join(documents.select("content_hash", "canonical_url", "document_id"), "content_hash")
    return each.groupBy("chunk_hash").agg(F.min(F.struct("canonical_url", "document_id", "ordinal")).alias("s")).select("chunk_hash", "s.*")


def provenance_update(before: DataFrame, content_chunks: DataFrame, documents: DataFrame, changed: DataFrame) -> DataFrame:
    """``before`` (a provenance) after the documents of the contents ``changed`` (content_hash) came, went or moved: only chunks of these contents are worked out anew."""
    affected = content_chunks.join(changed.select("content_hash").distinct(), "content_hash", "left_semi").select("chunk_hash").distinct()
    own = content_chunks.join(affected, "chunk_hash", "left_semi")
    return before.join(affected, "chunk_hash", "left_anti").unionByName(provenance(own, documents))


def merged(results: DataFrame) -> DataFrame:
    """A session's batches as one row each: sums of all counters, and the sorted union of failure_categories (array<string>). results: session, counters, failure_categories."""
    counters = [c for c, t in results.dtypes if t in ("int", "bigint", "double") and c != "session"]
    return results.groupBy("session").agg(*(F.sum(c).alias(c) for c in counters), F.array_sort(F.array_distinct(F.flatten(F.collect_list("failure_categories")))).alias("failure_categories"))


def sessions_summary(sessions: DataFrame) -> DataFrame:
    """One row: n_sessions, last_finished_at, latest_session (by start, then id), documents. sessions: session, started_at, finished_at, documents."""
    return sessions.agg(F.count("*").alias("n_sessions"), F.max("finished_at").alias("last_finished_at"), F.max_by("session", F.struct("started_at", "session")).alias("latest_session"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))


def batch_counts(batch_documents: DataFrame, batch_chunks: DataFrame, contents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, new and duplicate contents, chunks, new and duplicate chunks. A count of distinct new hashes, so that order doesn't matter."""
    d = batch_documents.join(contents.select("content_hash", F.lit(True).alias("known")), "content_hash", "left").agg(F.count("*").alias("documents"), F.count_distinct(F.when(F.col("known").isNull(), F.col("content_hash"))).alias("new_contents"))
    c = batch_chunks.join(chunks.select("chunk_hash", F.lit(True).alias("known")), "chunk_hash", "left").agg(F.count("*").alias("chunks"), F.count_distinct(F.when(F.col("known").isNull(), F.col("chunk_hash"))).alias("new_chunks"))
    return d.crossJoin(c).select("documents", "new_contents", (F.col("documents") - F.col("new_contents")).alias("duplicate_contents"), "chunks", "new_chunks", (F.col("chunks") - F.col("new_chunks")).alias("duplicate_chunks"))


def invalid_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, problem: chunks of no document in the batch, and repeated ordinals."""
    lone = chunks.join(documents.select("document_id"), "document_id", "left_anti").select("document_id", F.lit("unknown document").alias("problem")).distinct()
    twice = chunks.groupBy("document_id", "ordinal").count().where("count > 1").select("document_id", F.lit("repeated ordinal").alias("problem")).distinct()
    return lone.union(twice)


class Snapshot:
    """One version of a store; all tables read through it belong together, whatever is committed meanwhile."""

    def __init__(self, spark: SparkSession, root: str, version: str | None, manifest: dict):
        self.spark, self.root, self.version = spark, root, version
        self.parts: dict[str, list[str]] = manifest.get("parts") or {t: [f"{version}/{t}"] for t in TABLES if version}  # pointers of format 1 have no parts

    def rows(self, table: str) -> DataFrame:
        """All rows written, dead ones too."""
        paths = [f"{self.root}/{x}" for x in self.parts.get(table, [])]
        rows = self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])
        return rows.withColumn("seq", F.coalesce("seq", F.lit(-1).cast("long"))) if "seq" in rows.columns else rows  # format 1 has none for content_chunks

    def read(self, table: str) -> DataFrame:
        rows = self.rows(table)
        if len(self.parts.get(table, [])) + len(self.parts.get("documents", [])) <= 2:
            return rows  # one folder: as a compaction or a first batch left it
        if table == "documents":
            return latest(rows)
        if table == "content_chunks":
            last = rows.groupBy("content_hash").agg(F.max("seq").alias("seq"))
            return live(rows.join(last, ["content_hash", "seq"]).select(rows.columns), self.read("documents"), "content_hash")
        return live(rows, self.read("documents"), "content_hash") if table == "contents" else live(rows, self.read("content_chunks"), "chunk_hash")


class Store:
    """Versions below ``path``; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def pointers(self) -> list[str]:
        at = self._path(f"{self.path}/pointers")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at) if not x.getPath().getName().startswith(".")) if self.fs.exists(at) else []

    def version(self) -> str | None:
        """The current version: that of the highest pointer; pointers are written once and never changed."""
        names = self.pointers()
        return names[-1].split("-", 1)[1] if names else None

    def snapshot(self) -> Snapshot:
        names = self.pointers()
        if not names:
            return Snapshot(self.spark, self.path, None, {})
        manifest = json.loads(self.spark.read.text(f"{self.path}/pointers/{names[-1]}", wholetext=True).first()[0])
        if manifest["schema"] > VERSION:
            raise ValueError(f"a store of format {manifest['schema']}; this engine knows {VERSION}")
        return Snapshot(self.spark, self.path, names[-1].split("-", 1)[1], manifest)

    def read(self, table: str) -> DataFrame:
        return self.snapshot().read(table)

    def commit(self, tables: dict[str, DataFrame], note: dict, before: Snapshot, anew: bool = False) -> str:
        """Write ``tables`` beside those of ``before``, or in their place, and then the pointer."""
        v = uuid.uuid4().hex
        for name, df in tables.items():
            with run_once(self.spark):
                df.write.parquet(f"{self.path}/{v}/{name}")
        parts = {t: [*([] if anew else before.parts.get(t, [])), *([f"{v}/{t}"] if t in tables else [])] for t in TABLES}
        n = len(self.pointers())
        out = self.fs.create(self._path(f"{self.path}/pointers/{n:010d}-{v}"), False)
        out.write(bytearray(json.dumps({"schema": VERSION, "session": v, "before": before.version, "parts": parts, "finished_at": time.time(), **note}).encode()))
        out.close()
        return v

    def history(self) -> DataFrame:
        """The session log: a row for each commit."""
        return self.spark.read.json(f"{self.path}/pointers")

    def index(self, documents: DataFrame, contents: DataFrame, chunks: DataFrame) -> dict:
        """Index a batch. documents: DOCUMENTS; contents: content_hash, text; chunks: document_id, content_hash, ordinal and CHUNKS' columns. Returns its counts."""
        began, before = time.time(), self.snapshot()
        documents, contents, chunks = (stage(df, n) for df, n in ((documents, "documents"), (contents, "contents"), (chunks, "chunks")))
        if not (bad := invalid_chunks(chunks, documents)).isEmpty():
            raise ValueError(f"invalid batch: {bad.first().asDict()}")
        same = live(before.rows("contents"), contents, "content_hash").unionByName(contents)
        if not collisions(same, "content_hash", "text").isEmpty():
            raise ValueError("a content hash stands for two texts")
        seq = len(self.pointers())
        own = [x.split()[0] for x in CHUNKS.split(", ")]
        counts = batch_counts(documents, chunks, before.read("contents"), before.read("chunks")).first().asDict()
        tables = {
            "documents": latest(documents.select(*before.rows("documents").columns)).withColumn("seq", F.lit(seq).cast("long")),
            "contents": fresh(contents, before.rows("contents"), "content_hash"),
            "content_chunks": chunks.select("content_hash", F.col("ordinal").cast("int").alias("ordinal"), "chunk_hash", F.lit(seq).cast("long").alias("seq")).distinct(),
            "chunks": fresh(chunks.select(*own), before.rows("chunks"), "chunk_hash"),
        }
        self.commit(tables, {"started_at": began, **counts}, before)
        free(documents, contents, chunks)
        if len(self.snapshot().parts["documents"]) > COMPACT:
            self.compact()
        return counts

    def compact(self) -> str:
        """The live rows as one folder for each table."""
        now = self.snapshot()
        return self.commit({t: now.read(t) for t in TABLES}, {"started_at": time.time(), "documents": 0}, now, anew=True)

    def info(self) -> DataFrame:
        """One row: documents, contents, chunks, cleaned_tokens, and of the log n_sessions, last_finished_at, latest_session."""
        now = self.snapshot()
        d = now.read("documents").agg(F.count("*").alias("documents"), F.coalesce(F.sum("cleaned_tokens"), F.lit(0)).alias("cleaned_tokens"))
        out = d.crossJoin(now.read("contents").agg(F.count("*").alias("contents"))).crossJoin(now.read("chunks").agg(F.count("*").alias("chunks")))
        return out.crossJoin(sessions_summary(self.history()).drop("documents")) if now.version else out
