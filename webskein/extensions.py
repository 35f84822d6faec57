"""What a user may put in the place of the engine's own parts. Each works on tables or Columns, so that plans stay distributed; HashedWords and fuse() are the parts that are used otherwise."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame

from webskein.operators.semantic import Provider as EmbeddingProvider  # noqa: F401


class TokenEstimator(Protocol):
    """Tokens of a text, as an expression: built-in functions, or an Arrow UDF over a tokenizer."""

    def __call__(self, text: Column) -> Column: ...


class RetrievalStrategy(Protocol):
    """Answers a table of queries (query_id, query) with query_id, rank, key, score; what evaluate.run_queries() takes."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


class RankFusion(Protocol):
    """Makes one ranking of several in long form (query_id, strategy, weight, key, rank, raw_score)."""

    def __call__(self, rankings: DataFrame) -> DataFrame: ...


class Fetcher(Protocol):
    """Answers a table of urls (url) with url, status, html, problem; pages, robots files and sitemaps alike."""

    def __call__(self, urls: DataFrame) -> DataFrame: ...


class PageHandler(Protocol):
    """Turns a level's pages (url, html, depth) into what the storage takes."""

    def __call__(self, pages: DataFrame) -> DataFrame: ...


class DataStorage(Protocol):
    """Stores a table; may be given the same one again after a failure."""

    def __call__(self, table: DataFrame) -> None: ...
