"""URL filter: rules first, then a character language-model ratio, in DataFrame functions only.

A url that a rule fits gets that rule's verdict. All others are judged by two smoothed variable-order Markov models of characters, one of the urls that rules allow and one
of those they block: p_k(c | last k) = (n + D * p_{k-1}(c)) / (T + D) from order 3 down to a uniform 1/256 (T, D: occurrences and distinct symbols after the context).
The score is the mean over the url's symbols of log(p_allowed / p_blocked). About 3 of 16 ruled urls, by digest, are kept from training; the middle between the mean
scores of their two classes is the threshold (0 without both classes).

Model text: the url after ``://`` (all of it, if it has none), A-Z lower-cased, digits as one symbol, with three starts before and an end after.

Defined results. A url that is null or without ``://`` has empty host and path; no rule fits it, so the models judge it like any other; a null url is an empty text. Without any ruled url all scores are 0: allowed.
Each input row gives one row, repeated and null ids included. Long urls are taken whole. An empty table gives no rows. Only the named columns are read.

Scale. Character windows are counted before any shuffle. The models live in tables by window, never on the driver; a url's windows are joined with the
distinct windows' scores, salted, as windows such as a common domain's occur in most urls. What goes to the driver is eight numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.plans.staging import stage

#: verdict, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END, ORDER = "\x02", "\x03", 3
SALTS = 8


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host and path, empty where there is no ``://``, and the model's text."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path, F.translate(F.translate(F.when(F.locate("://", url) > 0, after).otherwise(url), UPPER, LOWER), "123456789", "0" * 9)


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule's name and verdict; rules are code, some hundreds at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def windows(text: Column) -> Column:
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))


def models(rows: DataFrame) -> tuple[DataFrame, tuple[float, ...]]:
    """(key, a, ad, r, rd) and the totals. rows: allowed, w. Key ``n`` + string: its occurrences; ``c`` + context: occurrences and distinct symbols after it."""
    grams = rows.groupBy("w").agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("r"))
    suffix = grams.select(F.explode(F.array(*(F.substr("w", F.lit(i + 1)) for i in range(ORDER + 1)))).alias("w"), "a", "r").groupBy("w").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    suffix = stage(suffix, "windows")
    after = suffix.groupBy(F.substr("w", F.lit(1), F.length("w") - 1).alias("w")).agg(F.sum("a").alias("a"), F.count_if(F.col("a") > 0).alias("ad"), F.sum("r").alias("r"), F.count_if(F.col("r") > 0).alias("rd"))
    keys = suffix.select(F.concat(F.lit("n"), "w").alias("key"), "a", F.lit(0).cast("long").alias("ad"), "r", F.lit(0).cast("long").alias("rd"))
    keys = keys.union(after.where("w <> ''").select(F.concat(F.lit("c"), "w"), "a", "ad", "r", "rd"))
    t = suffix.where(F.length("w") == 1).agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("a"), F.count_if(F.col("a") > 0), F.sum("r"), F.count_if(F.col("r") > 0)))).first()
    return keys, tuple(map(float, t))


def window_scores(distinct: DataFrame, keys: DataFrame, totals: tuple[float, ...]) -> DataFrame:
    """(w, lr): log(p_allowed / p_blocked) of each window's last symbol."""
    roles = [F.struct(F.lit(f"n{k}").alias("role"), F.concat(F.lit("n"), F.substr("w", F.lit(ORDER + 2 - k))).alias("key")) for k in range(1, ORDER + 2)]
    roles += [F.struct(F.lit(f"c{k}").alias("role"), F.concat(F.lit("c"), F.substr("w", F.lit(ORDER + 1 - k), F.lit(k))).alias("key")) for k in range(1, ORDER + 1)]
    asked = distinct.select("w", F.explode(F.array(*roles)).alias("x")).select("w", "x.role", "x.key")
    pick = lambda role, col: F.coalesce(F.max(F.when(F.col("role") == role, F.col(col))), F.lit(0)).cast("double")
    cols = [pick(f"n{k}", c).alias(f"n{k}_{c}") for k in range(1, ORDER + 2) for c in ("a", "r")]
    cols += [pick(f"c{k}", c).alias(f"c{k}_{c}") for k in range(1, ORDER + 1) for c in ("a", "ad", "r", "rd")]
    got = asked.hint("merge").join(keys, "key", "left").groupBy("w").agg(*cols)

    def p(c: str, total: float, kinds: float) -> Column:
        x = (F.col(f"n1_{c}") + kinds / 256) / (total + kinds) if total else F.lit(1 / 256)
        for k in range(1, ORDER + 1):
            t, d = F.col(f"c{k}_{c}"), F.col(f"c{k}_{c}d")
            x = F.when(t > 0, (F.col(f"n{k + 1}_{c}") + d * x) / (t + d)).otherwise(x)
        return x

    return got.select("w", (F.log(p("a", *totals[:2])) - F.log(p("r", *totals[2:]))).alias("lr"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per input row: page_id, host, path, rule, verdict, score, threshold."""
    host, path, after = host_and_path(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("row_id"), F.col(page_id).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(after, F.lit("")).alias("t"))
    name, verdict = fitting(F.col("host"), F.col("path"), rules)
    held = F.substr(F.md5(F.col("t").cast("binary")), F.lit(1), F.lit(1)).isin("0", "1", "2")
    rows = stage(rows.select("*", name.alias("rule"), verdict.alias("ruled"), held.alias("held")), "urls")
    keys, totals = models(rows.where("ruled is not null and not held").select((F.col("ruled") == "allow").alias("allowed"), F.explode(windows(F.col("t"))).alias("w")))
    judged = rows.where("ruled is null or held").select("row_id", F.explode(windows(F.col("t"))).alias("w"))
    scores = window_scores(judged.select("w").distinct(), keys, totals).select("w", "lr", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # exploded rows look as small to the planner as what they come from: they are merged, never broadcast
    by_row = stage(judged.withColumn("salt", (F.col("row_id") % SALTS).cast("int")).hint("merge").join(scores.hint("merge"), ["w", "salt"]).groupBy("row_id").agg(F.avg("lr").alias("score")), "scores")
    # a scan of compressed scores looks smaller to the planner than it is: merged too
    scored = rows.hint("merge").join(by_row.hint("merge"), "row_id", "left")
    fit = scored.where("held and ruled is not null").agg(F.avg(F.when(F.col("ruled") == "allow", F.col("score"))), F.avg(F.when(F.col("ruled") == "block", F.col("score")))).first()
    threshold = (fit[0] + fit[1]) / 2 if fit[0] is not None and fit[1] is not None else 0.0
    by_method = F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in cases)
    ruled = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in cases)

    def p(c: str) -> str:
        x = f"CASE WHEN g.t{c} > 0 THEN (coalesce(n1.{c}, 0) + g.d{c} / 256.0::DOUBLE) / (g.t{c} + g.d{c})::DOUBLE ELSE 1 / 256.0::DOUBLE END"
        for k in range(1, ORDER + 1):
            x = f"CASE WHEN coalesce(c{k}.{c}, 0) > 0 THEN (coalesce(n{k + 1}.{c}, 0) + c{k}.d{c} * ({x})) / (c{k}.{c} + c{k}.d{c})::DOUBLE ELSE ({x}) END"
        return x

    joins = " ".join(f"LEFT JOIN n n{k} ON n{k}.w = substr(u.w, {ORDER + 2 - k})" for k in range(1, ORDER + 2))
    joins += " " + " ".join(f"LEFT JOIN c c{k} ON c{k}.w = substr(u.w, {ORDER + 1 - k}, {k})" for k in range(1, ORDER + 1))
    return f"""
WITH s AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS after,
      CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE coalesce(url, '') END AS body FROM pages),
h AS (SELECT page_id, after, translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
      regexp_extract(substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
      translate(translate(body, '{UPPER}', '{LOWER}'), '123456789', '000000000') AS t FROM s),
r AS (SELECT row_number() OVER () AS i, *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, substr(md5(t), 1, 1) IN ('0', '1', '2') AS held FROM h),
x AS (SELECT *, repeat(chr(2), {ORDER}) || t || chr(3) AS padded FROM r),
e AS (SELECT *, unnest(list_transform(range(1, length(t) + 2), lambda i: substr(padded, i, {ORDER + 1}))) AS w FROM x),
g4 AS (SELECT w, count(*) FILTER (WHERE ruled = 'allow') AS a, count(*) FILTER (WHERE ruled = 'block') AS b FROM e WHERE ruled IS NOT NULL AND NOT held GROUP BY w),
n AS (SELECT substr(w, k) AS w, sum(a) AS a, sum(b) AS b FROM g4, range(1, {ORDER + 2}) q(k) GROUP BY ALL),
c AS (SELECT substr(w, 1, length(w) - 1) AS w, sum(a) AS a, count(*) FILTER (WHERE a > 0) AS da, sum(b) AS b, count(*) FILTER (WHERE b > 0) AS db FROM n GROUP BY ALL),
g AS (SELECT coalesce(sum(a), 0) AS ta, count(*) FILTER (WHERE a > 0) AS da, coalesce(sum(b), 0) AS tb, count(*) FILTER (WHERE b > 0) AS db FROM n WHERE length(w) = 1),
u AS (SELECT DISTINCT w FROM e WHERE ruled IS NULL OR held),
lr AS (SELECT u.w, ln({p("a")}) - ln({p("b")}) AS lr FROM u CROSS JOIN g {joins}),
sc AS (SELECT i, avg(lr) AS score FROM e JOIN lr USING (w) WHERE ruled IS NULL OR held GROUP BY i),
th AS (SELECT coalesce((avg(score) FILTER (WHERE ruled = 'allow') + avg(score) FILTER (WHERE ruled = 'block')) / 2, 0) AS t FROM r JOIN sc USING (i) WHERE held)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(score, 0) >= (SELECT t FROM th) THEN 'allow' ELSE 'block' END) AS verdict
FROM r LEFT JOIN sc USING (i)
"""


OP2_SQL = _sql()
