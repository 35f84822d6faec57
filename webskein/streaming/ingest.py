"""Structured Streaming: pages into the store as they come, idempotent sinks, live statistics, pacing with state, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webskein.functions.text import digest, token_estimate
from webskein.operators import chunk, html
from webskein.operators.store import Store
from webskein.plans.staging import stage
from webskein.sources import records


def batch_of(pages: DataFrame, config: chunk.ChunkConfig = chunk.ChunkConfig(), seq: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, contents and chunks of a batch of pages, as the store takes them. Pages without a usable url are left out."""
    # pages are parsed once: all three tables come from what is written here
    d = stage(html.source_documents(html.clean_pages(pages)).where("canonical_url <> ''").withColumn("seq", F.lit(seq).cast("long")), "parsed")
    size = pages.select("page_id", F.octet_length("html").cast("long").alias("source_bytes"), token_estimate(F.col("html")).alias("source_tokens"))
    d = d.join(size, "page_id")
    blocks = d.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.*")
    c = chunk.chunks(blocks.distinct(), d.select("document_id", F.col("canonical_url").alias("source_url"), "title").dropDuplicates(["document_id"]), config)
    hashes = d.select("document_id", "content_hash").dropDuplicates(["document_id"])
    chunks = c.select("document_id", "ordinal", F.col("content_hash").alias("chunk_hash"), "text", F.col("document_title").alias("title"), F.array_join("heading_path", " / ").alias("heading"), F.col("estimated_tokens").alias("n_tokens")).join(hashes, "document_id")
    documents = d.select("document_id", "url", "canonical_url", "title", "content_hash", "source_bytes", "cleaned_bytes", "source_tokens", "cleaned_tokens", "seq").dropDuplicates(["document_id"])
    return documents, d.select("content_hash", "text").dropDuplicates(["content_hash"]), chunks


def index_stream(pages: DataFrame, store: Store, checkpoint: str, config: chunk.ChunkConfig = chunk.ChunkConfig()):
    """Index a stream of pages (page_id, url, html), a version of the store for each micro-batch. A repeated batch finds all contents known."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            batch.persist()
            store.index(*batch_of(batch, config, batch_id))
            batch.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def archive_stream(stream: DataFrame, path: str, checkpoint: str):
    """Records to the archive, each once."""
    return stream.writeStream.foreachBatch(lambda b, _: records.archive(b, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, *content: str, at: str = "ts", within: str = "1 hour") -> DataFrame:
    """One row for each content within a time, by its hash; state goes with the watermark."""
    return stream.withColumn("content_hash", digest(*map(F.col, content))).withWatermark(at, within).dropDuplicatesWithinWatermark(["content_hash"])


def live_statistics(stream: DataFrame, ok: str = "status < 400") -> DataFrame:
    return stream.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.expr(ok)).alias("succeeded"), F.count_if(~F.expr(ok)).alias("failed"))


def live_progress(stream: DataFrame, total: int, at: str = "ts", ok: str = "status < 400") -> DataFrame:
    """One row that follows a stream: pages, succeeded, failed, rate a second, percent, eta in seconds."""
    x = stream.agg(F.count("*").alias("pages"), F.count_if(F.expr(ok)).alias("succeeded"), ((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6).alias("seconds"))
    rate = F.try_divide("pages", "seconds")
    return x.select("pages", "succeeded", (F.col("pages") - F.col("succeeded")).alias("failed"), rate.alias("rate"), (100.0 * F.col("pages") / total).alias("percent"), F.try_divide(F.greatest(F.lit(0), total - F.col("pages")), rate).alias("eta"))


def retry_accounts(stream: DataFrame, limit: int = 3) -> DataFrame:
    """url, attempts, state (done, waiting, given up) after each micro-batch's results (url, status), with the attempts so far as state of the url."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, said = state.get if state.exists else (0, "waiting")
        for p in parts:
            for status in p.sort_values("status", na_position="first")["status"]:
                if said != "waiting":
                    break
                n += 1
                said = "done" if status == status and 200 <= status < 400 else "given up" if n > limit or status in (400, 401, 403, 404, 410) else "waiting"
        state.update((n, said))
        yield pd.DataFrame({"url": [key[0]], "attempts": [n], "state": [said]})

    return stream.groupBy("url").applyInPandasWithState(run, "url string, attempts int, state string", "attempts int, said string", "update", "NoTimeout")


STATE = "last double"


def paced(stream: DataFrame, gap: float) -> DataFrame:
    """host, id, arrival, start: requests of a host at least ``gap`` seconds apart, across micro-batches, with the last start as state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        x = pd.concat(parts).sort_values(["arrival", "id"])
        starts = []
        for a in x["arrival"]:
            last = max(a, last + gap)
            starts.append(last)
        state.update((last,))
        yield x.assign(start=starts)[["host", "id", "arrival", "start"]]

    return stream.groupBy("host").applyInPandasWithState(run, "host string, id long, arrival double, start double", STATE, "append", "NoTimeout")


# beyond the crawl: event time


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", every: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width, every)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its rows, for tests."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
