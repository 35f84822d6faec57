"""Reciprocal rank fusion of any number of rankings, with contributions kept as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webskein.operators.lexical import top

#: Columns of rankings in long form: query_id, strategy, weight, key, rank, raw_score.
INF = 2**31 - 1


def fuse(rankings: DataFrame, k: float = 60.0, limit: int = 10, order: tuple[str, ...] = ("bm25", "semantic")) -> DataFrame:
    """query_id, rank, key, score, n_lists, ranks of ``order``'s strategies, contributions.

    A list of weight 0 still names candidates. Order: score, number of lists, best rank, then rank by strategy as in ``order``, then key."""
    if limit <= 0 or not k > 0:
        raise ValueError("limit and k must be positive")
    c = F.col("weight") / (F.lit(float(k)) + F.col("rank"))
    priority = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("strategy")), F.lit(0))
    part = F.struct(F.when(priority == 0, INF).otherwise(priority).alias("priority"), "strategy", "rank", "weight", "raw_score", c.alias("contribution"))
    ranks = [F.min(F.when(F.col("strategy") == s, F.col("rank"))).alias(f"{s}_rank") for s in order]
    fused = rankings.groupBy("query_id", "key").agg(F.array_sort(F.collect_list(part)).alias("contributions"), F.count("*").alias("n_lists"), F.min("rank").alias("best_rank"), *ranks)
    fused = fused.withColumn("score", F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x["contribution"]))
    by = [F.desc(F.round("score", 12)), F.desc("n_lists"), F.col("best_rank"), *(F.asc_nulls_last(f"{s}_rank") for s in order), F.col("key")]
    return top(fused, limit, *by).select("query_id", "rank", "key", "score", "n_lists", *(f"{s}_rank" for s in order), "contributions")


def problems(rankings: DataFrame) -> DataFrame:
    """query_id, strategy, problem of each list that can't be fused: ranks not 1, 2, …, a repeated key, a score that isn't finite, a negative weight."""
    g = rankings.groupBy("query_id", "strategy").agg(
        F.count("*").alias("n"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("key").alias("keys"),
        F.count_if(F.col("raw_score").isNull() | F.isnan("raw_score") | (F.abs("raw_score") == float("inf"))).alias("odd"), F.min("weight").alias("weight"),
    )
    what = F.when((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("ranks") != F.col("n")), "ranks").when(F.col("keys") != F.col("n"), "repeated key").when(F.col("odd") > 0, "score").when(F.col("weight") < 0, "weight")
    return g.select("query_id", "strategy", what.alias("problem")).where("problem is not null")


def disagreements(rankings: DataFrame, *columns: str) -> DataFrame:
    """query_id, key of candidates that the lists describe differently in any of ``columns``."""
    return rankings.groupBy("query_id", "key").agg(F.count_distinct(F.struct(*columns)).alias("n")).where("n > 1").select("query_id", "key")


def representatives(rankings: DataFrame, column: str, order: tuple[str, ...] = ("bm25", "semantic")) -> DataFrame:
    """query_id, key and ``column`` as the first list in ``order`` has it; lists that aren't named come last, by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    by = F.struct(F.when(place == 0, len(order) + 1).otherwise(place), "strategy")
    return rankings.groupBy("query_id", "key").agg(F.min_by(column, by).alias(column), F.min_by("strategy", by).alias("from_strategy"))


def readiness(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """One row of both sides' readiness. lexical: one row with n_chunks; semantic: one row with ready."""
    one = lexical.select((F.col("n_chunks") > 0).alias("lexical_ready"))
    return one.crossJoin(semantic.select(F.col("ready").alias("semantic_ready"))).withColumn("ready", F.col("lexical_ready") & F.col("semantic_ready"))


class RetrievalError(RuntimeError):
    """A component failed; ``strategy`` names it."""

    def __init__(self, strategy: str, error: Exception):
        super().__init__(f"{strategy}: {type(error).__name__}: {error}")
        self.strategy = strategy


def evidence(fused: DataFrame, order: tuple[str, str] = ("bm25", "semantic")) -> DataFrame:
    """query_id: candidates, in both lists, in one only."""
    a, b = (F.col(f"{s}_rank").isNotNull() for s in order)
    return fused.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(a & b).alias("overlap"), F.count_if(a & ~b).alias(f"{order[0]}_only"), F.count_if(~a & b).alias(f"{order[1]}_only"))
