"""Comparison of retrieval strategies: deltas, outcomes, overlap, coverage, fusion recovery and paired bootstrap intervals."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20260729


def deltas(summary: DataFrame, a: str, b: str, metrics: tuple[str, ...] = ("hit", "precision", "recall", "map", "ndcg", "mrr")) -> DataFrame:
    """k, metric, a, b, delta (b - a, null if either is) from summaries with a ``strategy`` column."""
    x, y = (summary.where(F.col("strategy") == s).select("k", F.posexplode(F.array(*(F.col(m).cast("double") for m in metrics))).alias("i", v)) for s, v in ((a, "a"), (b, "b")))
    return x.join(y, ["k", "i"]).select("k", F.get(F.array(*map(F.lit, metrics)), F.col("i")).alias("metric"), "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def quality(rows: DataFrame) -> DataFrame:
    """query_id, strategy, q: a struct that orders outcomes. rows: query_id, strategy, failed, n_relevant, n_results, ndcg, recall, rr."""
    z = lambda a, b, c: F.struct(F.lit(a).cast("double").alias("a") if not hasattr(a, "cast") else a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"))
    failed = z(-1.0, F.lit(-1.0), F.lit(-1.0))
    negative = z((F.col("n_results") == 0).cast("int"), -F.col("n_results"), F.lit(0.0))
    return rows.select("query_id", "strategy", "n_relevant", F.when(F.col("failed"), failed).when(F.col("n_relevant") == 0, negative).otherwise(z(F.col("ndcg"), F.col("recall"), F.col("rr"))).alias("q"))


def outcomes(rows: DataFrame, a: str, b: str) -> DataFrame:
    """query_id, outcome (win of b, loss, tie), success (both, a only, b only, neither) by a result's being above nothing, regression (a succeeded and b is worse)."""
    q = quality(rows)
    x, y = (q.where(F.col("strategy") == s).select("query_id", F.col("q").alias(n)) for s, n in ((a, "x"), (b, "y")))
    up = lambda c: F.col(f"{c}.a") > 0
    success = F.when(up("x") & up("y"), "both").when(up("x"), f"{a} only").when(up("y"), f"{b} only").otherwise("neither")
    regression = up("x") & (~up("y") | (F.col("y") < F.col("x")))
    return x.join(y, "query_id").select("query_id", F.when(F.col("y") > F.col("x"), "win").when(F.col("y") < F.col("x"), "loss").otherwise("tie").alias("outcome"), success.alias("success"), regression.alias("regression"))


RUN = ("dataset_name", "dataset_version", "dataset_signature", "chunking", "n_chunks", "limits", "token_budget")


def run_differences(runs: DataFrame, focus: int = 5) -> DataFrame:
    """problem: why runs can't be compared; none if they can. runs: strategy, RUN's columns (limits: array<int>), query_ids (array, in order)."""
    columns = [*RUN, "query_ids"]
    wide = runs.agg(*(F.count_distinct(F.struct(c)).alias(c) for c in columns), F.count_if(F.coalesce("dataset_signature", F.lit("")) == "").alias("unsigned"), F.count_if(~F.coalesce(F.array_contains("limits", focus), F.lit(False))).alias("unfocused"), F.count("*").alias("n"), F.count_distinct("strategy").alias("strategies"))
    found = [F.when(F.col(c) > 1, f"different {c}") for c in columns]
    found += [F.when(F.col("unsigned") > 0, "no dataset signature"), F.when(F.col("unfocused") > 0, f"no K={focus}"), F.when(F.col("strategies") < F.col("n"), "repeated strategy")]
    return wide.select(F.explode(F.array_compact(F.array(*found))).alias("problem"))


def by_category(rows: DataFrame, strategies: tuple[str, ...], metric: str = "rr") -> DataFrame:
    """category and a column for each strategy: the mean of ``metric`` over its positive queries (0 without one; null without the category). rows: query_id, strategy, category, n_relevant, metric."""
    mean = F.coalesce(F.avg(F.when(F.col("n_relevant") > 0, F.col(metric))), F.lit(0.0))
    return rows.groupBy("category").pivot("strategy", list(strategies)).agg(mean)


def classes(rows: DataFrame, a: str = "bm25", b: str = "semantic", fused: str = "hybrid") -> DataFrame:
    """class, query_ids (sorted): the seven outcomes of a fused strategy and its components. Columns as for quality()."""
    q = quality(rows).groupBy("query_id").agg(*(F.max(F.when(F.col("strategy") == s, F.col("q"))).alias(n) for s, n in ((a, "x"), (b, "y"), (fused, "f"))))
    x, y, f = F.col("x"), F.col("y"), F.col("f")
    up = lambda c: c["a"] > 0
    tests = {
        f"{fused} wins": (f > x) & (f > y), f"{fused} beats {a}": f > x, f"{fused} beats {b}": f > y, f"{a} wins": (x > y) & (x > f), f"{b} wins": (y > x) & (y > f),
        "regression": (up(x) | up(y)) & (f < F.greatest(x, y)), "all fail": ~(up(x) | up(y) | up(f)),
    }
    names = F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))
    return q.select("query_id", F.explode(names).alias("class")).groupBy("class").agg(F.array_sort(F.collect_list("query_id")).alias("query_ids"))


def query_evidence(rows: DataFrame, items: DataFrame, missed: DataFrame, k: int = 5) -> DataFrame:
    """A row for each query and strategy: first (rank of the first relevant item), recall and ndcg at k, items (rank, key, grade, judgment_id in rank order), missed.

    rows: query_id, strategy, k, recall, ndcg; items: query_id, strategy, rank, key, grade, judgment_id; missed: query_id, strategy, missed."""
    own = items.groupBy("query_id", "strategy").agg(F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.array_sort(F.collect_list(F.struct("rank", "key", "grade", "judgment_id"))).alias("items"))
    by = ["query_id", "strategy"]
    return rows.where(F.col("k") == k).select(*by, "recall", "ndcg").join(own, by, "left").join(missed, by, "left")


def overlap(retrieved: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """a, b, k, n_queries, shared, united, micro and macro Jaccard of all unordered pairs of strategies; two empty sets are alike (1.0).

    retrieved: query_id, strategy, rank, key. Queries in which a strategy has no result count as empty sets."""
    everyone = retrieved.select("query_id").distinct().crossJoin(retrieved.select("strategy").distinct())
    sets = everyone.join(retrieved, ["query_id", "strategy"], "left").groupBy("query_id", "strategy").agg(*(F.collect_set(F.when(F.col("rank") <= k, F.col("key"))).alias(f"s{k}") for k in ks))
    x = sets.select("query_id", F.col("strategy").alias("a"), *(F.col(f"s{k}").alias(f"a{k}") for k in ks))
    y = sets.select("query_id", F.col("strategy").alias("b"), *(F.col(f"s{k}").alias(f"b{k}") for k in ks))
    per = x.join(y, "query_id").where("a < b").select("query_id", "a", "b", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.size(F.array_intersect(f"a{k}", f"b{k}")).alias("i"), F.size(F.array_union(f"a{k}", f"b{k}")).alias("u")) for k in ks))).alias("v"))
    i, u = F.col("v.i"), F.col("v.u")
    return per.groupBy("a", "b", F.col("v.k").alias("k")).agg(
        F.count("*").alias("n_queries"), F.sum(i).alias("shared"), F.sum(u).alias("united"), F.coalesce(F.try_divide(F.sum(i), F.sum(u)), F.lit(1.0)).alias("micro"), F.avg(F.coalesce(F.try_divide(i, u), F.lit(1.0))).alias("macro")
    )


def found_by(judgments: DataFrame, credited: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """query_id, judgment_id, in_a, in_b: whether each strategy credits a positive judgment within k. credited: query_id, strategy, rank, judgment_id."""
    has = credited.where(F.col("judgment_id").isNotNull() & (F.col("rank") <= k)).groupBy("query_id", "judgment_id").agg(F.bool_or(F.col("strategy") == a).alias("in_a"), F.bool_or(F.col("strategy") == b).alias("in_b"))
    no = F.lit(False)
    return judgments.where("relevance > 0").select("query_id", "judgment_id").join(has, ["query_id", "judgment_id"], "left").select("query_id", "judgment_id", F.coalesce("in_a", no).alias("in_a"), F.coalesce("in_b", no).alias("in_b"))


def coverage(judgments: DataFrame, credited: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """One row: both, a_only, b_only, neither."""
    x, y = F.col("in_a"), F.col("in_b")
    return found_by(judgments, credited, a, b, k).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))


def oracle_recall(judgments: DataFrame, credited: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """One row: micro and macro recall of the union of two strategies."""
    per = found_by(judgments, credited, a, b, k).groupBy("query_id").agg(F.count_if(F.col("in_a") | F.col("in_b")).alias("f"), F.count("*").alias("n"))
    return per.agg(F.coalesce(F.try_divide(F.sum("f"), F.sum("n")), F.lit(0.0)).alias("micro"), F.coalesce(F.avg(F.col("f") / F.col("n")), F.lit(0.0)).alias("macro"))


def recovery(judgments: DataFrame, credited: DataFrame, a: str, b: str, fused: str, k: int) -> DataFrame:
    """One row: judgments that exactly one component finds, how many of them the fused list finds, and the rate."""
    one = found_by(judgments, credited, a, b, k).where("in_a <> in_b").select("query_id", "judgment_id")
    has = credited.where((F.col("strategy") == fused) & F.col("judgment_id").isNotNull() & (F.col("rank") <= k)).select("query_id", "judgment_id").distinct().withColumn("ok", F.lit(True))
    return one.join(has, ["query_id", "judgment_id"], "left").agg(F.count("*").alias("single"), F.count_if(F.coalesce("ok", F.lit(False))).alias("recovered")).withColumn("rate", F.try_divide("recovered", "single"))


def exclusive(retrieved: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """query_id, key, strategy of candidates that one of two strategies alone has in its top k: their symmetric difference. retrieved: query_id, strategy, rank, key."""
    own = retrieved.where(F.col("strategy").isin(a, b) & (F.col("rank") <= k)).groupBy("query_id", "key").agg(F.collect_set("strategy").alias("by"))
    return own.where(F.size("by") == 1).select("query_id", "key", F.col("by")[0].alias("strategy"))


def contribution(fused: DataFrame, retrieved: DataFrame, a: str = "bm25", b: str = "semantic", k: int = 5) -> DataFrame:
    """One row of a fused top k: shares of items from both lists, one, none; means over those that have them; promotions (above both ranks) of dual items; exclusive candidates and how many stay.

    fused: query_id, rank, key, contributions and ranks as fuse() gives them; retrieved: query_id, strategy, rank, key of the components."""
    x = fused.where(F.col("rank") <= k)
    one, two = F.col(f"{a}_rank"), F.col(f"{b}_rank")
    dual, n = one.isNotNull() & two.isNotNull(), F.count("*")
    of = lambda s, c: F.get(F.filter("contributions", lambda p: p["strategy"] == s), F.lit(0))[c]
    kinds = {"dual": dual, f"{a}_only": one.isNotNull() & two.isNull(), f"{b}_only": one.isNull() & two.isNotNull(), "unattributed": one.isNull() & two.isNull()}
    share = lambda p, q: F.coalesce(F.try_divide(p, q), F.lit(0.0))
    own = x.agg(
        n.alias("n"), *(F.count_if(c).alias(m) for m, c in kinds.items()), *(share(F.count_if(c), n).alias(f"{m}_share") for m, c in kinds.items()),
        *(F.avg(of(s, "contribution")).alias(f"mean_{s}_contribution") for s in (a, b)), *(F.avg(of(s, "raw_score")).alias(f"mean_{s}_score") for s in (a, b)),
        F.count_if(dual & (F.col("rank") < F.least(one, two))).alias("promoted"), share(F.count_if(dual & (F.col("rank") < F.least(one, two))), F.count_if(dual)).alias("promotion_rate"),
    )
    kept = exclusive(retrieved, a, b, k).join(x.select("query_id", "key", F.lit(True).alias("kept")), ["query_id", "key"], "left").agg(F.count("*").alias("exclusive"), F.count_if("kept").alias("retained"))
    return own.crossJoin(kept.withColumn("retention_rate", share(F.col("retained"), F.col("exclusive"))))


def percentile(ordered: list[float], q: float) -> float:
    """Linear interpolation between the two nearest of sorted values."""
    at = q * (len(ordered) - 1)
    low = int(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)


def resampled(values: list[float], samples: int, seed: int) -> tuple[float, float, float]:
    """Mean and the 95 % interval of the means of samples drawn with replacement."""
    if not values:
        return 0.0, 0.0, 0.0
    rng, n = random.Random(seed), len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(samples))
    return sum(values) / n, percentile(means, 0.025), percentile(means, 0.975)


def bootstrap(paired: DataFrame, samples: int = 5000, seed: int = SEED) -> DataFrame:
    """metric, n, mean, low, high of paired differences (metric, query_id, delta).

    One metric's differences, a number for each evaluated query, are resampled in one place by one generator, so that intervals repeat exactly."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("query_id")["delta"].tolist()
        mean, low, high = resampled(d, samples, seed)
        return pd.DataFrame({"metric": [pdf["metric"].iloc[0]], "n": [len(d)], "mean": [mean], "low": [low], "high": [high]})

    return paired.where("delta is not null").select("metric", "query_id", "delta").groupBy("metric").applyInPandas(run, "metric string, n long, mean double, low double, high double")


def bootstrap_distributed(paired: DataFrame, samples: int = 5000, seed: int = 1) -> DataFrame:
    """The same for any number of queries: Poisson(1) weights by hash of sample and query, as native aggregates over exploded samples."""
    u = F.pmod(F.xxhash64("query_id", "b", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    w = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
    each = paired.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("w", w)
    means = each.groupBy("metric", "b").agg(F.try_divide(F.sum(F.col("delta") * F.col("w")), F.sum("w")).alias("m"))
    real = paired.groupBy("metric").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"))
    return means.groupBy("metric").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p")).join(real, "metric").select("metric", "n", "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
