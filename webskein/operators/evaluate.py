"""Retrieval evaluation over long tables: crediting of judgments, metrics at K, summaries and diagnoses."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webskein.functions.text import evidence
from webskein.plans.staging import free, stage

#: judgments: query_id, judgment_id, document_id, canonical_url, section_id, heading_path, evidence, relevance (0 to 3).
#: retrieved: query_id, rank, document_id, canonical_url, section_id, heading_path, text.
METRICS = ("hit", "precision", "recall", "ap", "ndcg")


def candidates(retrieved: DataFrame, judgments: DataFrame) -> DataFrame:
    """query_id, rank, judgment_id, relevance of all pairs that match.

    The document may match by id or by canonical url: two equi-joins and a union, as a disjunction would be a nested loop. Section, heading path and quoted evidence must match where a judgment has them."""
    j = judgments.where("relevance > 0").select(*(F.col(c).alias(f"j_{c}") for c in ("query_id", "judgment_id", "document_id", "canonical_url", "section_id", "heading_path", "evidence", "relevance")))
    q = F.col("query_id") == F.col("j_query_id")
    rest = (
        (F.col("j_section_id").isNull() | (F.col("j_section_id") == F.col("section_id")))
        & (F.col("j_heading_path").isNull() | (F.col("j_heading_path") == F.col("heading_path")))
        & (F.col("j_evidence").isNull() | F.contains(evidence(F.col("text")), evidence(F.col("j_evidence"))))
    )
    pick = ["query_id", "rank", F.col("j_judgment_id").alias("judgment_id"), F.col("j_relevance").alias("relevance")]
    by = [retrieved.join(j, q & (F.col(c) == F.col(f"j_{c}"))).where(rest).select(*pick) for c in ("document_id", "canonical_url")]
    return by[0].union(by[1]).distinct()


def credited(retrieved: DataFrame, matches: DataFrame) -> DataFrame:
    """query_id, rank, grade, judgment_id: in rank order each item takes the best judgment that none before it took (highest relevance, then smallest id).

    The fold is over one query's results, which the retrieval depth bounds."""
    m = matches.groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("order"), "judgment_id"))).alias("js"))
    items = retrieved.select("query_id", "rank").join(m, ["query_id", "rank"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "js"))).alias("items"))
    kind = "array<struct<rank:int,grade:int,judgment_id:string>>"
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(kind).alias("out"))

    def add(acc, x):
        free = F.filter(F.coalesce(x["js"], F.array().cast("array<struct<order:int,judgment_id:string>>")), lambda j: ~F.array_contains(acc["used"], j["judgment_id"].cast("string")))
        best = F.get(free, F.lit(0))
        one = F.struct(x["rank"].cast("int").alias("rank"), F.coalesce(-best["order"], F.lit(0)).cast("int").alias("grade"), best["judgment_id"].cast("string").alias("judgment_id"))
        return F.struct(F.when(F.size(free) > 0, F.concat(acc["used"], F.array(best["judgment_id"].cast("string")))).otherwise(acc["used"]).alias("used"), F.concat(acc["out"], F.array(one).cast(kind)).alias("out"))

    return items.select("query_id", F.explode(F.aggregate("items", start, add, lambda acc: acc["out"])).alias("x")).select("query_id", "x.rank", "x.grade", "x.judgment_id")


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def metrics(queries: DataFrame, grades: DataFrame, judgments: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """query_id, k, hit, precision, recall, ap, ndcg, rr (over the full depth), n_results, n_relevant; a row for each query and K, with or without results.

    queries: query_id. grades: query_id, rank, grade. judgments: query_id, relevance. Precision divides by K whatever the number of results."""
    ideal = W.partitionBy("query_id").orderBy(F.desc("relevance"))
    pos = judgments.where("relevance > 0").select("query_id", "relevance", F.row_number().over(ideal).alias("i"))
    at = lambda cond, x: F.sum(F.when(cond, x))
    relevant = pos.groupBy("query_id").agg(F.count("*").alias("n_relevant"), *(at(F.col("i") <= k, gain(F.col("relevance"), F.col("i"))).alias(f"idcg_{k}") for k in ks))
    seen = F.sum((F.col("grade") > 0).cast("int")).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    g = grades.select("query_id", "rank", "grade", seen.alias("seen"))
    hit = F.col("grade") > 0
    aggs = [F.count("*").alias("n_results"), F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.count_if(hit & inside).alias(f"n_{k}"), at(hit & inside, F.col("seen") / F.col("rank")).alias(f"ap_{k}"), at(inside, gain(F.col("grade"), F.col("rank"))).alias(f"dcg_{k}")]
    all_ = queries.select("query_id").join(relevant, "query_id", "left").join(g.groupBy("query_id").agg(*aggs), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n_rel = F.coalesce("n_relevant", F.lit(0))
    rows = [
        F.struct(
            F.lit(k).alias("k"), zero((F.col(f"n_{k}") > 0).cast("double")).alias("hit"), zero(F.col(f"n_{k}") / F.lit(float(k))).alias("precision"), zero(F.try_divide(F.col(f"n_{k}"), n_rel)).alias("recall"),
            zero(F.try_divide(F.col(f"ap_{k}"), F.least(n_rel, F.lit(k)))).alias("ap"), zero(F.try_divide(F.col(f"dcg_{k}"), F.col(f"idcg_{k}"))).alias("ndcg"),
        )
        for k in ks
    ]
    return all_.select("query_id", zero(1 / F.col("first")).alias("rr"), F.coalesce("n_results", F.lit(0)).alias("n_results"), n_rel.alias("n_relevant"), F.explode(F.array(*rows)).alias("m")).select("query_id", "m.*", "rr", "n_results", "n_relevant")


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Means over positive queries and the share of negative ones without a result, by K and ``by``; failed queries must have been left out.

    Without positive queries means are 0; without negative ones no_result_accuracy is null."""
    pos = F.col("n_relevant") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(pos, F.col(c))), F.lit(0.0)).alias("mrr" if c == "rr" else "map" if c == "ap" else c)
    return rows.groupBy(*by, "k").agg(F.count_if(pos).alias("n_positive"), F.count_if(~pos).alias("n_negative"), *(mean(c) for c in (*METRICS, "rr")), F.avg(F.when(~pos, (F.col("n_results") == 0).cast("double"))).alias("no_result_accuracy"))


def by_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """The summary of each category and, with a null category, of all, in one pass."""
    x = rows.join(categories, "query_id")
    pos = F.col("n_relevant") > 0
    return x.rollup("k", "category").agg(F.count("*").alias("n"), *(F.coalesce(F.avg(F.when(pos, F.col(c))), F.lit(0.0)).alias(c) for c in (*METRICS, "rr"))).where("k is not null")


def context_quality(selected: DataFrame) -> DataFrame:
    """One row from selected items (query_id, n_tokens, grade): relevant chunks for 1000 tokens, share of tokens in irrelevant chunks."""
    t = F.sum("n_tokens")
    return selected.agg(F.coalesce(F.try_divide(1000.0 * F.count_if(F.col("grade") > 0), t), F.lit(0.0)).alias("relevant_per_1000"), F.coalesce(F.try_divide(F.sum(F.when(F.col("grade") == 0, F.col("n_tokens")).otherwise(0)), t), F.lit(0.0)).alias("irrelevant_share"))


def latency(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, p95 (nearest rank), max."""
    return samples.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("max"))


def worst(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n queries of highest penalty; rows: query_id, failed, n_relevant, n_results, hit, missed, first, irrelevant_share."""
    penalty = (
        F.when(F.col("failed"), 10_000.0)
        .when(F.col("n_relevant") == 0, F.when(F.col("n_results") > 0, 2_000.0 + 10 * F.col("n_results")).otherwise(0.0))
        .otherwise(1000 * (1 - F.col("hit")) + 100 * F.col("missed") + 10 * (F.coalesce("first", F.lit(1)) - 1) + 50 * F.col("irrelevant_share"))
    )
    return rows.withColumn("penalty", penalty).orderBy(F.desc("penalty"), F.desc("query_id")).limit(n)


def strongest(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n best positive queries that didn't fail; rows: query_id, failed, n_relevant, ndcg, rr, irrelevant_share."""
    return rows.where(~F.col("failed") & (F.col("n_relevant") > 0)).orderBy(F.desc("ndcg"), F.desc("rr"), F.col("irrelevant_share"), F.desc("query_id")).limit(n)


def false_positives(items: DataFrame, n: int = 20) -> DataFrame:
    """The n first retrieved items of grade 0: of negative queries first, then by their query's share of irrelevant tokens. items: query_id, rank, grade, n_relevant, irrelevant_share."""
    return items.where("grade = 0").orderBy(F.when(F.col("n_relevant") == 0, 0).otherwise(1), F.desc("irrelevant_share"), "query_id", "rank").limit(n)


def missed(judgments: DataFrame, credited: DataFrame) -> DataFrame:
    """query_id, missed: the sorted judgments with a grade that no retrieved item got, of each query that has any."""
    got = credited.where("judgment_id is not null").select("query_id", "judgment_id").distinct()
    left = judgments.where("relevance > 0").select("query_id", "judgment_id").join(got, ["query_id", "judgment_id"], "left_anti")
    return left.groupBy("query_id").agg(F.array_sort(F.collect_set("judgment_id")).alias("missed"))


def document_ids(retrieved: DataFrame, documents: DataFrame) -> DataFrame:
    """``retrieved`` with document_id as the dataset knows it: by canonical url, else by url, else as it came. documents: document_id, url.

    Each row comes back once: of documents that repeat a url, the one with the smallest id counts."""
    known = documents.groupBy(F.col("url").alias("known_url")).agg(F.min("document_id").alias("known_id"))
    by = lambda df, c, name: df.join(known.select(F.col("known_url").alias(c), F.col("known_id").alias(name)), c, "left")
    out = by(by(retrieved, "canonical_url", "by_canonical"), "url", "by_url")
    return out.withColumn("document_id", F.coalesce("by_canonical", "by_url", "document_id")).select(*retrieved.columns)


def section_ids(retrieved: DataFrame, sections: DataFrame) -> DataFrame:
    """``retrieved`` with the section_id that the dataset gives to its document and heading path. sections: section_id, document_id, heading_path."""
    own = sections.groupBy("document_id", "heading_path").agg(F.min("section_id").alias("known_section"))
    out = retrieved.drop("section_id").join(own, ["document_id", "heading_path"], "left")
    return out.withColumnRenamed("known_section", "section_id")


def run_queries(queries: DataFrame, search: Callable[[DataFrame], DataFrame], warmups: int = 3, repeats: int = 3) -> tuple[DataFrame, DataFrame, list[str]]:
    """(retrieved, samples, warnings): a strategy's results for all queries, the seconds of each repeat, and what went wrong.

    ``search`` answers a table of queries (query_id, query) by one plan, and is run once on the first ``warmups`` queries, then ``repeats`` times on all. If the batch fails, queries are run
    one by one, so that only those that fail themselves have no results: they come back with ``failed``, one row of null rank each. An order that changes between repeats is a warning."""
    spark, warnings, samples, first = queries.sparkSession, [], [], None
    if repeats <= 0:
        raise ValueError("repeat latency must be positive")
    try:
        search(queries.orderBy("query_id").limit(warmups)).collect()
    except Exception as e:  # noqa: BLE001 - a strategy is the user's
        warnings.append(f"warm-up failed: {type(e).__name__}")
    try:
        for i in range(repeats):
            began = time.perf_counter()
            got = stage(search(queries), "retrieved")
            samples.append((i, time.perf_counter() - began))
            if first is None:
                first = got
            else:
                differs = first.select("query_id", "rank", "key").exceptAll(got.select("query_id", "rank", "key"))
                if not differs.isEmpty():
                    warnings.append(f"repeat {i} ranks {differs.select('query_id').distinct().count()} queries in another order")
                free(got)
        out = first.withColumn("failed", F.lit(False))
    except Exception as e:  # noqa: BLE001
        warnings.append(f"batch failed: {type(e).__name__}")
        out, ids = None, [r[0] for r in queries.select("query_id").orderBy("query_id").collect()]
        for q in ids:
            one = queries.where(F.col("query_id") == q)
            try:
                part = stage(search(one), "retrieved").withColumn("failed", F.lit(False))
            except Exception as e2:  # noqa: BLE001
                warnings.append(f"{q}: {type(e2).__name__}")
                part = one.select("query_id", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("failed"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, spark.createDataFrame(samples, "repeat int, seconds double"), warnings


def ranking_problems(retrieved: DataFrame) -> DataFrame:
    """query_id, problem of rankings that can't be scored."""
    g = retrieved.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("rank").alias("ranks"),
        F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("odd"), F.count_if(F.coalesce(F.trim("document_id"), F.lit("")) == "").alias("blank"), F.count_if(F.coalesce("n_tokens", F.lit(0)) <= 0).alias("free"),
    )
    what = F.when((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("ranks") != F.col("n")), "ranks").when(F.col("blank") > 0, "blank id").when(F.col("odd") > 0, "score").when(F.col("free") > 0, "tokens")
    return g.select("query_id", what.alias("problem")).where("problem is not null")


def dataset_problems(documents: DataFrame, sections: DataFrame, queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """location, problem: everything wrong with an evaluation dataset at once.

    documents: document_id, url, content; sections: section_id, document_id, heading_path; queries: query_id, query, category; judgments as above."""
    found = [
        documents.groupBy("document_id").count().where("count > 1").select(F.concat(F.lit("document "), "document_id"), F.lit("repeated id")),
        documents.groupBy("url").count().where("count > 1").select(F.concat(F.lit("url "), "url"), F.lit("repeated url")),
        documents.where(~F.lower("url").rlike("^https?://[^/\\s]+")).select(F.concat(F.lit("document "), "document_id"), F.lit("invalid url")),
        sections.join(documents, "document_id", "left_anti").select(F.concat(F.lit("section "), "section_id"), F.lit("unknown document")),
        sections.where(F.size("heading_path") < 1).select(F.concat(F.lit("section "), "section_id"), F.lit("no heading")),
        queries.groupBy("query_id").count().where("count > 1").select(F.concat(F.lit("query "), "query_id"), F.lit("repeated id")),
        queries.where(F.coalesce(F.trim("query"), F.lit("")) == "").select(F.concat(F.lit("query "), "query_id"), F.lit("blank query")),
        judgments.join(queries, "query_id", "left_anti").select(F.concat(F.lit("judgment "), "judgment_id"), F.lit("unknown query")),
        judgments.join(documents, "document_id", "left_anti").select(F.concat(F.lit("judgment "), "judgment_id"), F.lit("unknown document")),
        judgments.where(F.col("section_id").isNotNull()).join(sections, ["section_id", "document_id"], "left_anti").select(F.concat(F.lit("judgment "), "judgment_id"), F.lit("unknown section")),
        judgments.where(~F.col("relevance").between(0, 3)).select(F.concat(F.lit("judgment "), "judgment_id"), F.lit("grade out of range")),
        judgments.groupBy("query_id", "document_id", "section_id").count().where("count > 1").select(F.concat(F.lit("query "), "query_id"), F.lit("repeated target")),
        judgments.where("evidence is not null").join(documents.select("document_id", "content"), "document_id").where(~F.contains(evidence(F.col("content")), evidence(F.col("evidence")))).select(F.concat(F.lit("judgment "), "judgment_id"), F.lit("evidence not in document")),
        queries.join(judgments.where("relevance > 0").select("query_id").distinct().withColumn("has", F.lit(True)), "query_id", "left").where((F.col("category") == "negative") == F.coalesce("has", F.lit(False))).select(F.concat(F.lit("query "), "query_id"), F.lit("negative if and only if nothing is relevant")),
    ]
    out = found[0].toDF("location", "problem")
    for f in found[1:]:
        out = out.union(f)
    return out
