"""Token-budgeted context: whole chunks in rank order; one that doesn't fit is passed over, not the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of hits: query_id, rank, content_hash, document_id, n_tokens, source_tokens.


def select_context(hits: DataFrame, budget: int = 3000) -> DataFrame:
    """query_id, candidates (before removal of repeats), n_selected, used_tokens, reduction, selected (array of rank, content_hash).

    The fold is over one query's hits, which a retrieval depth bounds. Reduction compares with the source tokens of all distinct documents among candidates."""
    if budget <= 0:
        raise ValueError("budget must be positive")
    once = hits.groupBy("query_id", "content_hash").agg(F.min(F.struct("rank", "content_hash", "document_id", "n_tokens", "source_tokens")).alias("h"), F.count("*").alias("times"))
    per = once.groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("hs"), F.sum("times").alias("candidates"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,content_hash:string>>").alias("taken"))

    def add(acc, h):
        fits = acc["used"] + h["n_tokens"] <= budget
        one = F.array(F.struct(h["rank"].cast("int").alias("rank"), h["content_hash"].cast("string").alias("content_hash")))
        return F.struct((acc["used"] + F.when(fits, h["n_tokens"]).otherwise(0)).cast("long").alias("used"), F.when(fits, F.concat(acc["taken"], one)).otherwise(acc["taken"]).alias("taken"))

    docs = F.array_distinct(F.transform("hs", lambda h: F.struct(h["document_id"].alias("d"), h["source_tokens"].alias("t"))))
    source = F.aggregate(docs, F.lit(0).cast("long"), lambda s, d: s + d["t"])
    folded = per.select("query_id", "candidates", source.alias("source"), F.aggregate("hs", start, add).alias("f"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("f.used") / F.nullif(F.col("source"), F.lit(0))))
    return folded.select("query_id", "candidates", F.size("f.taken").cast("long").alias("n_selected"), F.col("f.used").alias("used_tokens"), F.coalesce(share, F.lit(0.0)).alias("reduction"), F.col("f.taken").alias("selected"))
