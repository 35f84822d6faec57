"""Crawl record sinks: JSON Lines, CSV, and an append-only Parquet archive that takes each record once."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.functions.text import digest

SCHEMA = "url string, title string, text string, links array<string>, metadata map<string,string>, crawled_at timestamp, status_code int, content_type string"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def problems(records: DataFrame) -> Column:
    """Why a record can't be stored, or null."""
    missing = F.lit(None).cast("string")
    for f in reversed(FIELDS):
        missing = F.when(F.col(f).isNull(), F.lit(f"missing {f}")).otherwise(missing)
    return F.coalesce(missing, F.when(~F.col("status_code").between(100, 599), "status out of range"))


def checked(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be stored, and the others with their ``problem``."""
    x = records.withColumn("problem", problems(records))
    return x.where("problem is null").drop("problem"), x.where("problem is not null")


def record_key() -> Column:
    """SHA-256 over all fields in a fixed order; maps by sorted key."""
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return digest(F.col("url"), F.col("title"), F.col("text"), F.array_join("links", "\x01"), F.array_join(pairs, "\x01"), F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.col("status_code"), F.col("content_type"))


def write_jsonl(records: DataFrame, path: str) -> None:
    records.select(*FIELDS).write.mode("append").json(path)


def write_csv(records: DataFrame, path: str) -> None:
    """Nested columns as JSON text, one header a file."""
    flat = [F.to_json(c).alias(c) if c in ("links", "metadata") else F.col(c) for c in FIELDS]
    records.select(*flat).write.mode("append").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv wrote, with nested columns again."""
    flat = ", ".join(f"{c} string" if c in ("links", "metadata") else x for c, x in zip(FIELDS, SCHEMA.split(", ")))
    raw = spark.read.schema(flat).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return raw.withColumns({"links": F.from_json("links", "array<string>"), "metadata": F.from_json("metadata", "map<string,string>")})


def archive(records: DataFrame, path: str) -> int:
    """Append records that aren't there yet; the same batch again adds nothing. Returns how many were new."""
    spark = records.sparkSession
    new = records.select(*FIELDS).withColumn("record_key", record_key()).dropDuplicates(["record_key"])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):  # any failure to read what is there is an error
        new = new.join(spark.read.parquet(path).select("record_key"), "record_key", "left_anti")
    n = new.persist().count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def write_json_array(records: DataFrame, path: str, indent: int | None = 2, most: int = 100_000) -> int:
    """Records as one JSON array in a local file, beside it first and then in its place. More than ``most`` records are refused: they belong in JSON Lines."""
    rows = [json.loads(r[0]) for r in records.select(F.to_json(F.struct(*FIELDS))).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} records")
    beside = f"{path}.part"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=indent, ensure_ascii=False)
    os.replace(beside, path)
    return len(rows)


def bounded_json(hits: DataFrame, cap: int = 65_536, columns: Sequence[str] | None = None) -> DataFrame:
    """query_id, rank, json of the best-ranked hits whose serialised sizes add up to ``cap`` bytes at most; the lowest-ranked go. ``columns``: what a hit's object holds, in order."""
    from pyspark.sql import Window as W

    row = F.to_json(F.struct(*(columns or (c for c in hits.columns if c != "query_id"))))
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return hits.select("query_id", "rank", row.alias("json")).withColumn("used", F.sum(F.octet_length("json")).over(w)).where(F.col("used") <= cap)
