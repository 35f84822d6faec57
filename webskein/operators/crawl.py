"""Crawl analytics: link graph, bounded breadth-first frontier, admission, URL policy, robots rules, pacing, retries and statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webskein.functions.urls import address_class, host, is_http, percent_normal, port
from webskein.operators import html
from webskein.plans.staging import stage

TRANSIENT = (408, 429, 500, 502, 503, 504)


def edges(parsed: DataFrame) -> DataFrame:
    """src, pos, dst of parsed pages' links."""
    return parsed.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "dst"))


def admitted(urls: DataFrame, column: str = "url", domains: Sequence[str] | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Links a crawl takes: valid, of one of ``domains`` if given, of no excluded pattern, of an included one if there are any."""
    u = F.col(column)
    keep = is_http(u)
    if domains is not None:
        keep &= host(u).isin(*domains)
    for p in exclude:
        keep &= ~u.rlike(p)
    if include:
        any_ = F.lit(False)
        for p in include:
            any_ |= u.rlike(p)
        keep &= any_
    return urls.where(keep)


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int, max_pages: int | None = None, per_host: int | None = None) -> DataFrame:
    """url, depth, seq: breadth-first order from seeds (url) over links (src, pos, dst); each url once, at its least depth.

    A level is one join of the new urls with the links and one anti-join with what was seen; levels are written, so that lineage stays short. ``max_pages`` counts attempts;
    ``per_host`` defers a host's further urls of a level to the end of that level."""
    level = stage(seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit("").alias("via"), F.lit(0).alias("pos")), "level")
    seen = level
    for d in range(1, max_depth + 1):
        out = links.join(level.select(F.col("url").alias("src")), "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("src", "pos")).alias("first"))
        level = stage(out.join(seen.select("url"), "url", "left_anti").select("url", F.lit(d).alias("depth"), F.col("first.src").alias("via"), F.col("first.pos").alias("pos")), "level")
        if level.isEmpty():
            break
        seen = seen.union(level)
    turn = F.lit(0)
    if per_host:
        turn = F.floor((F.row_number().over(W.partitionBy("depth", host(F.col("url"))).orderBy("via", "pos", "url")) - 1) / per_host)
    ordered = seen.withColumn("turn", turn)
    if max_pages is not None:
        ordered = ordered.orderBy("depth", "turn", "via", "pos", "url").limit(max_pages)
    return ordered.select("url", "depth", F.row_number().over(W.partitionBy("depth").orderBy("turn", "via", "pos", "url")).alias("seq"))


def policy(urls: DataFrame, column: str = "url", allow_hosts: Sequence[str] | None = None, allow_private: bool = False) -> DataFrame:
    """``urls`` with ``refused``: null for a url that may be fetched, else why not."""
    u, h = F.col(column), host(F.col(column))
    local = (h == "localhost") | h.endswith(".localhost") | h.endswith(".local")
    listed = F.lit(True)
    if allow_hosts is not None:
        listed = F.lit(False)
        for a in allow_hosts:
            listed |= (h == a.lower()) | h.endswith("." + a.lower())
    kind = F.col("__class")
    return (
        urls.withColumn("__class", address_class(h))
        .withColumn(
            "refused",
            F.when(u.isNull() | u.rlike(r"\s") | u.rlike(r"^[^:]*://[^/?#]*\\"), "malformed").when(~u.rlike("(?i)^https?://"), "scheme").when(u.rlike(r"^[^:]*://[^/?#]*@"), "credentials")
            .when(h.isNull(), "host").when(port(u).isNull() | ~port(u).between(1, 65535), "port").when(F.lit(not allow_private) & local, "local name")
            .when(F.lit(not allow_private) & kind.isNotNull() & (kind != "public"), "address").when(~listed, "not listed"),
        )
        .drop("__class")
    )


def moved(queue: DataFrame, done: DataFrame) -> DataFrame:
    """A frontier's next state. queue: url, state; done: url, ok. Active urls that are done become processed or failed, other active ones go back, and a failed or processed url never moves again."""
    after = F.when(F.col("state") != "active", F.col("state")).when(F.col("ok"), "processed").when(~F.col("ok"), "failed").otherwise("queued")
    return queue.join(done.groupBy("url").agg(F.max("ok").alias("ok")), "url", "left").select("url", after.alias("state"))


def taken(queue: DataFrame, n: int, order: str = "url") -> DataFrame:
    """The first n queued urls become active."""
    first = queue.where("state = 'queued'").orderBy(order).limit(n).select("url", F.lit(True).alias("go"))
    return queue.join(first, "url", "left").withColumn("state", F.when(F.col("go"), "active").otherwise(F.col("state"))).drop("go")


def crawl(
    seeds: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    max_depth: int = 3,
    max_pages: int | None = 1000,
    admit: Callable[[DataFrame], DataFrame] | None = None,
    handle: Callable[[DataFrame], DataFrame] | None = None,
    save: Callable[[DataFrame], None] | None = None,
    attempts: int = 3,
) -> DataFrame:
    """A bounded breadth-first crawl: url, depth, status, problem of every attempt, in levels that are fetched, parsed, handed on and saved as tables.

    ``fetch`` takes a table of urls and returns url, status, html, problem; ``admit`` drops links and seeds (domains, patterns, policy, robots). ``handle`` turns a level's pages (url, depth, html) into what ``save``
    stores, which is tried ``attempts`` times, so it must take repeats. Seeds may come from sitemaps; ``max_pages`` counts attempts and cuts a level in order of discovery; None: no limit."""
    admit = admit or (lambda df: df)
    level = stage(admit(seeds.select("url").distinct()).withColumn("seq", F.struct(F.lit("").alias("src"), F.lit(0).alias("pos"), "url")), "level")
    seen, log, left = level.select("url"), None, max_pages
    for d in range(max_depth + 1):
        now = stage((level if left is None else level.orderBy("seq").limit(left)).select("url"), "now")
        n = now.count()
        if not n:
            break
        got = stage(fetch(now).select("url", "status", "html", "problem"), "fetched")
        pages = got.where("html is not null").select("url", "html", F.lit(d).alias("depth"))
        if save is not None:
            for attempt in range(1, attempts + 1):
                try:
                    save(handle(pages) if handle else pages)
                    break
                except Exception:
                    if attempt == attempts:
                        raise
        rows = got.select("url", F.lit(d).alias("depth"), "status", "problem")
        log, left = (rows if log is None else log.unionByName(rows)), None if left is None else left - n
        if left == 0 or d == max_depth:
            break
        found = edges(html.parse_pages(pages.select(F.monotonically_increasing_id().alias("page_id"), "url", "html")))
        new = found.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("src", "pos", F.col("dst").alias("url"))).alias("seq"))
        level = stage(admit(new).join(seen, "url", "left_anti").select("url", "seq"), "level")
        seen = seen.union(level.select("url"))
    return log if log is not None else seeds.sparkSession.createDataFrame([], "url string, depth int, status int, problem string")


# robots


def robots_cache(cached: DataFrame, origins: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: Column, ttl: float = 3600.0) -> DataFrame:
    """origin, groups, at: every origin's rules, from the cache while younger than ``ttl`` seconds, and fetched once for each origin otherwise.

    cached: origin, groups, at (seconds); ``fetch`` takes a table of distinct origins and returns origin, groups."""
    wanted = origins.select("origin").where("origin is not null").distinct()
    fresh = cached.where(F.col("at") > now - ttl).groupBy("origin").agg(F.max_by(F.struct("groups", "at"), "at").alias("x")).select("origin", "x.groups", "x.at").join(wanted, "origin", "left_semi")
    stale = stage(wanted.join(fresh.select("origin"), "origin", "left_anti"), "origins")
    return fresh.unionByName(fetch(stale).select("origin", "groups", now.cast("double").alias("at")))


def parse_robots(text: str) -> list[dict]:
    """Groups of a robots file: user_agents, allow, disallow, crawl_delay. Consecutive agent lines share a group."""
    groups, agents_open = [], False
    for line in (text or "").splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not agents_open:
                groups.append({"user_agents": [], "allow": [], "disallow": [], "crawl_delay": None})
            groups[-1]["user_agents"].append(value.lower())
            agents_open = True
        elif groups and key in ("allow", "disallow", "crawl-delay"):
            agents_open = False
            if key == "crawl-delay":
                try:
                    groups[-1]["crawl_delay"] = max(0.0, float(value))
                except ValueError:
                    pass
            elif value:
                groups[-1][key].append(value)
    return groups


_strings = T.ArrayType(T.StringType())
GROUPS = T.ArrayType(T.StructType([T.StructField("user_agents", _strings), T.StructField("allow", _strings), T.StructField("disallow", _strings), T.StructField("crawl_delay", T.DoubleType())]))


@F.pandas_udf(GROUPS)
def robots_groups(text: pd.Series) -> pd.Series:
    return text.map(parse_robots)


def robots_available(status: Column) -> Column:
    """What a robots fetch says without a file: deny all (401, 403, 5xx, no answer), allow all (others), or read it (2xx)."""
    return F.when(status.isNull() | status.isin(401, 403) | (status >= 500), "deny").when(status.between(200, 299), "read").otherwise("allow")


def rule_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: * for anything, a final $ for the end."""
    quoted = F.regexp_replace(pattern, r"([\\.+?()\[\]{}|^])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$"))


def robots_decisions(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """url, allowed, crawl_delay. urls: url, origin, path; robots: origin, groups.

    The most specific group whose agent is contained in ours holds (``*`` last); among its matching rules the longest wins, and allow wins a tie. An origin without rules allows."""
    name = agent.lower()
    g = robots.select("origin", F.explode("groups").alias("g"))
    fits = F.filter("g.user_agents", lambda a: (a == "*") | ((a != "") & F.contains(F.lit(name), a)))
    g = g.select("origin", "g", F.array_max(F.transform(fits, lambda a: F.when(a == "*", 0).otherwise(F.length(a)))).alias("specific")).where("specific is not null")
    best = g.groupBy("origin").agg(F.max("specific").alias("specific"))
    mine = g.join(best, ["origin", "specific"])
    rules = mine.select("origin", F.explode(F.concat(F.transform("g.allow", lambda p: F.struct(p.alias("p"), F.lit(True).alias("allow"))), F.transform("g.disallow", lambda p: F.struct(p.alias("p"), F.lit(False).alias("allow"))))).alias("r"))
    rules = rules.select("origin", percent_normal(F.col("r.p")).alias("p"), F.col("r.allow").alias("allow"))
    paths = urls.select("url", "origin", percent_normal(F.coalesce("path", F.lit("/"))).alias("path"))
    hit = paths.join(rules, "origin").where(F.rlike(F.col("path"), rule_regex(F.col("p"))))
    verdict = hit.groupBy("url").agg(F.max(F.struct(F.length("p").alias("n"), "allow")).alias("v")).select("url", F.col("v.allow").alias("allow"))
    delay = mine.groupBy("origin").agg(F.max("g.crawl_delay").alias("crawl_delay"))
    return urls.select("url", "origin").join(verdict, "url", "left").join(delay, "origin", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"), "crawl_delay")


# pacing and retries


def schedule(requests: DataFrame, gap: float, key: str = "host", at: str = "arrival") -> DataFrame:
    """``requests`` with ``start``: no two starts of a key closer than ``gap`` seconds, none before its arrival.

    start_i = max over j <= i of arrival_j + (i - j) * gap: a running maximum, so that no fold is needed."""
    w = W.partitionBy(key).orderBy(at, "id")
    i = F.row_number().over(w)
    shifted = requests.withColumn("__i", i).withColumn("__x", F.col(at) - F.col("__i") * gap)
    return shifted.withColumn("start", F.max("__x").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("__i") * gap).drop("__i", "__x")


def interval(per_second: float, min_delay: float, crawl_delay: Column, jitter: float, *key: str) -> Column:
    """Seconds between two starts of a host: what the rate allows, or the longer of our delay and the site's with a jitter that follows from ``key``."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 20)) / float(1 << 20)
    return F.greatest(F.lit(1.0 / per_second), F.greatest(F.lit(float(min_delay)), F.coalesce(crawl_delay, F.lit(0.0))) + jitter * u)


def schedule_by(requests: DataFrame, gap: Column, key: str = "host", at: str = "arrival") -> DataFrame:
    """As schedule(), where each request has its own ``gap`` to the one before: with g_i the sum of gaps up to i, start_i = g_i + max over j <= i of (arrival_j - g_j)."""
    w = W.partitionBy(key).orderBy(at, "id").rowsBetween(W.unboundedPreceding, 0)
    x = requests.withColumn("__g", F.sum(gap).over(w)).withColumn("__x", F.col(at) - F.col("__g"))
    return x.withColumn("start", F.max("__x").over(w) + F.col("__g")).drop("__g", "__x")


def intervals(requests: DataFrame, key: str = "host", at: str = "start") -> DataFrame:
    """n and mean seconds between consecutive requests of a key."""
    d = F.col(at) - F.lag(at).over(W.partitionBy(key).orderBy(at))
    return requests.withColumn("__d", d).groupBy(key).agg(F.count("*").alias("n"), F.avg("__d").alias("mean_interval"))


def error_class(status: Column) -> Column:
    return F.when(status.isin(*TRANSIENT), "transient").when(status.between(400, 599), "permanent").when(status.between(200, 399), "ok").otherwise("network")


def backoff(attempt: Column, status: Column, retry_after: Column, base: float = 0.5, factor: float = 2.0, most: float = 30.0) -> Column:
    """Seconds before the next attempt: exponential, doubled at 429, never under what Retry-After says."""
    x = F.least(F.lit(most), base * F.pow(F.lit(factor), attempt - 1))
    return F.greatest(F.when(status == 429, 2 * x).otherwise(x), F.coalesce(retry_after, F.lit(0.0)))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a number, or an HTTP date; 0 for anything else and for what is past."""
    seconds = value.try_cast("double")
    date = F.regexp_extract(value, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    until = F.unix_micros(F.try_to_timestamp(F.concat(F.when(F.length(date) == 19, F.concat(F.lit("0"), date)).otherwise(F.nullif(date, F.lit(""))), F.lit(" +00:00")), F.lit("dd MMM yyyy HH:mm:ss xxx"))) / 1e6
    wait = F.when(seconds.isNotNull(), F.when(F.isnan(seconds) | (F.abs(seconds) == float("inf")), 0.0).otherwise(seconds)).otherwise(until - F.unix_micros(now) / 1e6)
    return F.greatest(F.lit(0.0), F.coalesce(wait, F.lit(0.0)))


def may_retry(attempt: Column, status: Column, limit: int = 3) -> Column:
    return (error_class(status).isin("transient", "network")) & (attempt < F.when(status == 500, 2).otherwise(limit + 1))


def retry_statistics(errors: DataFrame) -> DataFrame:
    """error_type, errors, retries, mean_delay, permanent_urls. errors: error_type, url, retry_scheduled, retry_delay."""
    r = F.col("retry_scheduled")
    return errors.groupBy("error_type").agg(F.count("*").alias("errors"), F.count_if(r).alias("retries"), F.avg(F.when(r, F.col("retry_delay"))).alias("mean_delay"), F.count_distinct(F.when(~r, F.col("url"))).alias("permanent_urls"))


def permanent_urls(errors: DataFrame) -> DataFrame:
    """error_type, urls: the sorted urls that won't be tried again."""
    return errors.where(~F.col("retry_scheduled")).groupBy("error_type").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def diagnosis(errors: DataFrame, message: str = "message") -> DataFrame:
    """One row: why a crawl came back empty, by the gravest of its errors."""
    has = lambda words: F.coalesce(F.bool_or(F.contains(F.col(message), F.lit(words))), F.lit(False))
    why = F.when(has("URLPolicyError"), "crawl was blocked by the configured URL network policy").when(has("Blocked by robots.txt"), "site access is blocked by robots.txt").when(has("response exceeds"), "crawl response exceeded the server byte limit")
    return errors.agg(why.otherwise("crawl returned no indexable pages; verify the URL, robots.txt, and site availability").alias("diagnosis"))


FAILURES = (("timeout", "timeout"), ("timed out", "timeout"), ("robots", "robots"), ("429", "rate limited"), ("rate limit", "rate limited"), ("404", "not found"), ("403", "forbidden"), ("500", "server error"), ("503", "server error"), ("connection", "connection"), ("ssl", "tls"))


def failure_category(message: Column) -> Column:
    """The first category whose words a message holds."""
    out = F.lit("other")
    for word, name in reversed(FAILURES):
        out = F.when(F.contains(F.lower(message), F.lit(word)), name).otherwise(out)
    return F.when(message.isNotNull(), out)


# statistics


def status_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))


def top_domains(pages: DataFrame, n: int = 10, order: str = "page_id") -> DataFrame:
    """domain, n: the most frequent hosts, ties by first seen."""
    return pages.select(host(F.col("url")).alias("domain"), order).where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(n)


def progress(log: DataFrame, total: int, ok: Column, seconds: Column) -> DataFrame:
    """One row: pages, succeeded, failed, rate a second, percent, eta in seconds."""
    x = log.agg(F.count("*").alias("pages"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.max(seconds).alias("seconds"))
    rate = F.try_divide("pages", "seconds")
    return x.select("pages", "succeeded", "failed", rate.alias("rate"), (100.0 * F.col("pages") / total).alias("percent"), F.try_divide(F.greatest(F.lit(0), total - F.col("pages")), rate).alias("eta"))


def queue_states(queue: DataFrame) -> DataFrame:
    return queue.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("queued", "active", "processed", "failed")))
