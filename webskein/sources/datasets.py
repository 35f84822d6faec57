"""Evaluation datasets on disk: a manifest, HTML files and JSON Lines queries; and their signature."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = "array<struct<judgment_id:string,document_id:string,section_id:string,heading_path:array<string>,relevance:int,canonical_source:string,evidence:string>>"


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """documents, sections, queries, judgments. The manifest names documents and their files below ``root``."""
    m = spark.read.option("multiLine", True).json(f"{root}/manifest.json").select(F.explode("documents").alias("d")).select("d.*")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(root).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("content"))
    documents = m.join(files, F.element_at(F.split("path", "/"), -1) == F.col("file"), "left")
    sections = documents.select("document_id", F.explode("sections").alias("s")).select("document_id", "s.section_id", "s.heading_path")
    q = spark.read.schema(f"query_id string, query string, category string, relevant_sources {SOURCES}").json(f"{root}/queries.jsonl")
    judgments = q.select("query_id", F.explode("relevant_sources").alias("r")).select("query_id", "r.*").withColumnRenamed("canonical_source", "canonical_url")
    return {"documents": documents.select("document_id", "url", "title", "content"), "sections": sections, "queries": q.select("query_id", "query", "category"), "judgments": judgments}


def subset(queries: DataFrame, categories: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Queries of some categories or ids; an unknown id or an empty choice is an error."""
    out = queries
    if categories:
        out = out.where(F.col("category").isin(categories))
    if ids:
        known = {r[0] for r in queries.where(F.col("query_id").isin(ids)).select("query_id").collect()}
        if lost := sorted(set(ids) - known):
            raise ValueError(f"unknown queries: {', '.join(lost)}")
        out = out.where(F.col("query_id").isin(ids))
    if out.isEmpty():
        raise ValueError("no query is left")
    return out


def signature(root: str) -> str:
    """A digest over all files, each with its name and length before it."""
    h = hashlib.sha256()
    for p in sorted(x for x in Path(root).rglob("*") if x.is_file()):
        for part in (p.relative_to(root).as_posix().encode(), p.read_bytes()):
            h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


def fingerprint(config: dict) -> str:
    """A model's identity from its configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
