"""WARC writing, reading and transaction assembly.

``write_archives`` writes request, response (or revisit) and metadata records as gzip members, one file set per task.
``read_archives`` streams the files back, one row per record, without payloads. ``assemble`` joins the records of a
capture through ``WARC-Concurrent-To`` and emits one nested row per capture.

Defined results. A null payload is an empty one, a null url an empty target. A row without page id is always a response.
Each input row makes one capture, rows that repeat another one wholly too: record ids hold the row's place in the input, so that these come back apart; of several rows of
the smallest page id all are responses, and revisits name the first. Payloads under ``min_revisit_bytes`` are never revisited. A very long payload is held whole, as one record, by the task that writes or reads it.
An empty table gives no archives and no rows. Columns other than the three named are not read, whatever their names.
A place is that in the input's partitions: a scan of files has the same ones whenever it is read; an input that is shuffled without an order is to be staged first.

Scale. Payloads move at most once: the table of repeated payloads is narrow and is written first, so the planner
broadcasts it if its size allows and shuffles otherwise (its hot digests are salted). A task streams: it holds one record when
writing and one buffer when reading. Task attempts that fail leave files that no manifest names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.plans.staging import new_path, stage

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "record_id string, type string, concurrent_to string, target_uri string, refers_to string, payload_bytes long, payload_digest string, "
    "digest_ok boolean, page_id long, refers_to_page long, file string, offset long"
)
DATE = "2024-01-01T00:00:00Z"
SALTS = 8


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_id(kind: str, row: int, page: object, url: str, digest: str) -> str:
    """The same for every attempt of a task, so that a revisit can name a record that another task writes."""
    return "<urn:uuid:" + str(uuid.UUID(bytes=hashlib.sha256(f"{kind}\0{row}\0{page}\0{url}\0{digest}".encode()).digest()[:16])) + ">"


def _member(kind: str, rid: str, fields: list[tuple[str, str]], content_type: str, block: list[bytes]) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Date: {DATE}\r\n"]
    head += [f"{k}: {v}\r\n" for k, v in fields]
    head.append(f"Content-Type: {content_type}\r\nContent-Length: {sum(map(len, block))}\r\n\r\n")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    parts = [z.compress("".join(head).encode())]
    parts += [z.compress(b) for b in block]
    return b"".join([*parts, z.compress(b"\r\n\r\n"), z.flush()])


def _line(url: str) -> str:
    """A url as a header value: without line ends, which would end the header."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def capture(row: int, page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None, first_row: int | None) -> list[bytes]:
    """The three records of a capture. first: the page that this one revisits."""
    url = _line(url or "")
    rid = record_id("response", row, page, url, digest)
    path = url.split("://", 1)[-1]
    host, _, rest = path.partition("/")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    note = f"page-id: {'' if page is None else page}\r\n"
    if first is None:
        main = _member("response", rid, fields, "application/http; msgtype=response", [http, payload])
    else:
        note += f"refers-to-page-id: {first}\r\n"
        fields += [("WARC-Refers-To", record_id("response", first_row, first, _line(first_url or ""), digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        main = _member("revisit", rid, fields, "application/http; msgtype=response", [http])
    beside = [("WARC-Target-URI", url), ("WARC-Concurrent-To", rid)]
    request = f"GET /{rest} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    return [
        _member("request", record_id("request", row, page, url, digest), beside, "application/http; msgtype=request", [request]),
        main,
        _member("metadata", record_id("metadata", row, page, url, digest), beside, "application/warc-fields", [note.encode()]),
    ]


def write_archives(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", body: str = "html", min_revisit_bytes: int = 100, file_mb: int = 256) -> DataFrame:
    """Write a capture per row below ``out``; return the manifest of the finished files (path, records, bytes).

    Writing is an action of this call. ``file_mb``: a task starts another file beyond so many compressed megabytes."""
    p = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    seen = p.where((F.octet_length("payload") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "row", "url")).alias("first"), F.count("*").alias("n"))
    first = stage(seen.where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.row").alias("first_row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")), "first")
    revisits = F.col("page_id") != F.col("first_id")
    rows = p.join(first, ["digest", "salt"], "left").select("row", "page_id", "url", "payload", "digest", F.when(revisits, F.col("first_id")).alias("first_id"), F.when(revisits, F.col("first_url")).alias("first_url"), F.when(revisits, F.col("first_row")).alias("first_row"))

    def write(batches):
        files, base = _open(out)
        files.create_dir(base, recursive=True)
        token, seen, sink, name, records, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", set(), None, "", 0, 0
        done, part = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    name = f"{base}/{token}-{part:04d}.warc.gz"
                    sink, records, size, part = files.open_output_stream(name, compression=None), 0, 0, part + 1
                for x in capture(*row):
                    sink.write(x)
                    records, size = records + 1, size + len(x)
                if size > file_mb << 20:
                    sink.close()
                    done.append((f"{out}/{name.rsplit('/', 1)[1]}", records, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((f"{out}/{name.rsplit('/', 1)[1]}", records, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d)) for d in done], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stage(rows.mapInArrow(write, MANIFEST), "manifest")


def members(stream, chunk: int = 1 << 20):
    """(offset, bytes) of each gzip member of a stream; holds one member and one chunk."""
    z, out, offset, at = zlib.decompressobj(31), [], 0, 0
    data = stream.read(chunk)
    while data:
        out.append(z.decompress(data))
        if z.eof:
            at += len(data) - len(z.unused_data)
            yield offset, b"".join(out)
            data, offset, out, z = z.unused_data or stream.read(chunk), at, [], zlib.decompressobj(31)
        else:
            at += len(data)
            data = stream.read(chunk)
    if out and any(out):
        raise ValueError(f"the archive ends within the member at {offset}")


def _headers(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogateescape").split("\r\n")[1:])}


def parse(member: bytes, file: str, offset: int) -> dict:
    """A record's row. The digest is taken anew from a response's payload and held against the header."""
    head, _, rest = member.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    row = {"record_id": h["warc-record-id"], "type": h["warc-type"], "concurrent_to": h.get("warc-concurrent-to"), "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "file": file, "offset": offset}
    if row["type"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = h.get("warc-payload-digest", "").rpartition(":")[2]
        if row["type"] == "response":
            row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
        else:
            row |= {"payload_bytes": int(_headers(http).get("content-length", 0)), "payload_digest": said}
        row["digest_ok"] = row["payload_digest"] == said
    elif row["type"] == "metadata":
        note = _headers(b"\r\n" + block)
        row |= {k: int(note[n]) if note.get(n) else None for k, n in (("page_id", "page-id"), ("refers_to_page", "refers-to-page-id"))}
    return row


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the files that a manifest's ``path`` names; a task streams one file at a time."""
    schema = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_()}.get(t, pa.string())) for n, t in (x.split() for x in RECORDS.split(", "))])
    paths = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                files, name = _open(path)
                with files.open_input_stream(name, compression=None) as stream:
                    rows = []
                    for offset, member in members(stream):
                        rows.append(parse(member, path, offset))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return paths.mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the records that share a concurrent-to identifier, and the record it names.

    Request and metadata records point at the response, so that its id keys the transaction: one shuffle of rows without
    payloads. A record missing from a transaction leaves a null struct."""

    def part(kinds: list[str], *cols: str) -> Column:
        return F.max(F.when(F.col("type").isin(*kinds), F.struct(*cols)))

    return (
        records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
        .groupBy("capture_id")
        .agg(
            part(["request"], "record_id", "target_uri", "file", "offset").alias("request"),
            part(["response", "revisit"], "record_id", "type", "target_uri", "payload_bytes", "payload_digest", "digest_ok", "refers_to", "file", "offset").alias("response"),
            part(["metadata"], "record_id", "page_id", "refers_to_page", "file", "offset").alias("metadata"),
        )
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = assemble(read_archives(write_archives(pages, new_path(spark, "archives"))))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("metadata.refers_to_page").alias("refers_to"),
    )


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
