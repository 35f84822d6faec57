"""Links, URLs, crawl policy, pacing, statistics, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.catalogue.indexing import pages
from webskein.functions import urls
from webskein.operators import crawl, html
from webskein.plans.staging import stage
from webskein.sources import records, sitemap
from webskein.streaming import ingest


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", urls.without_fragment(F.col("url")).alias("normal"), urls.scheme(F.col("url")).alias("scheme"), urls.host(F.col("url")).alias("host"), urls.port(F.col("url")).alias("port"), urls.is_http(F.col("url")).alias("is_http"))


def link_rows(spark: SparkSession, d: str) -> DataFrame:
    return crawl.edges(html.parse_pages(pages(spark, d)))


def same_origin_links(spark: SparkSession, d: str) -> DataFrame:
    return link_rows(spark, d).groupBy(urls.host(F.col("src")).alias("host")).agg(F.count("*").alias("links"), F.count_if(urls.same_origin(F.col("src"), F.col("dst"))).alias("same_origin"))


def domain_top10(spark: SparkSession, d: str) -> DataFrame:
    return crawl.top_domains(pages(spark, d))


def link_admission(spark: SparkSession, d: str) -> DataFrame:
    return crawl.admitted(pages(spark, d), domains=None, include=[r"\.example\.(com|net)/"], exclude=[r"utm_source", r"ads-"]).select("page_id", "url")


def host_graph(spark: SparkSession, d: str) -> DataFrame:
    """Links between pages made of the page table itself: page i links to pages 2i and 2i + 1."""
    i = F.col("page_id")
    return pages(spark, d).select(i.alias("i"), F.posexplode(F.array(2 * i, 2 * i + 1)).alias("pos", "j")).select(F.concat(F.lit("https://h"), (F.col("i") % 5).cast("string"), F.lit("/"), "i").alias("src"), "pos", F.concat(F.lit("https://h"), (F.col("j") % 5).cast("string"), F.lit("/"), "j").alias("dst"))


def link_frontier_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Over all links of all pages, from each host's first page on, until nothing new is found."""
    first = pages(spark, d).where(urls.is_http(F.col("url"))).groupBy(urls.host(F.col("url"))).agg(F.min_by("url", "page_id").alias("url"))
    return crawl.frontier(first.select("url"), stage(link_rows(spark, d), "links"), 1000).select("url", "depth")


def crawl_walk(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of the page table by the whole loop: the table answers for its urls, and links to two sites are followed."""
    p = pages(spark, d)
    answers = p.select("url", F.lit(200).alias("status"), "html", F.lit(None).cast("string").alias("problem")).dropDuplicates(["url"])
    fetch = lambda asked: asked.join(answers, "url", "left").select("url", F.coalesce("status", F.lit(404)).alias("status"), "html", "problem")
    log = crawl.crawl(p.select("url"), fetch, max_depth=1, max_pages=None, admit=lambda u: crawl.admitted(u, include=[r"\.example\.(com|net)/"]))
    return log.select("url", "depth", "status")


def frontier_tree(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([("https://h1/1",), ("https://h3/3",)], "url string")
    return crawl.frontier(seeds, host_graph(spark, d), 6).select("url", "depth")


def frontier_fair(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 attempts, two of a host at a turn."""
    return crawl.frontier(spark.createDataFrame([("https://h1/1",)], "url string"), host_graph(spark, d), 8, max_pages=40, per_host=2).select("url", "depth", "seq")


def frontier_states(spark: SparkSession, d: str) -> DataFrame:
    """A queue of all pages after the first 100 were taken and half of them done."""
    q = crawl.taken(pages(spark, d).select("page_id", "url", F.lit("queued").alias("state")).groupBy("url").agg(F.min("page_id").alias("page_id"), F.min("state").alias("state")), 100, "page_id")
    done = q.where("state = 'active' and page_id % 2 = 0").select("url", (F.col("page_id") % 4 == 0).alias("ok"))
    return crawl.queue_states(crawl.moved(q, done))


def origins(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", urls.origin(F.col("url")).alias("origin"), urls.robots_url(F.col("url")).alias("robots"))


def robots_cached(spark: SparkSession, d: str) -> DataFrame:
    """Rules of all origins from a cache of which half is old: where they come from."""
    o = pages(spark, d).select(urls.origin(F.col("url")).alias("origin"))
    rules = lambda df, name: df.withColumn("groups", F.array(F.lit(name)))
    cached = rules(o.distinct(), "cached").withColumn("at", F.when(F.length("origin") % 2 == 0, 9000.0).otherwise(10.0))
    got = crawl.robots_cache(cached, o, lambda new: rules(new, "fetched"), F.lit(10_000.0))
    return got.select("origin", F.get("groups", F.lit(0)).alias("rules"), "at")


def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """Retry-After as seconds, dates in the future and past, and nonsense."""
    i = F.col("event_id")
    v = F.when(i % 5 == 0, F.concat((i % 100).cast("string"), F.lit(".5"))).when(i % 5 == 1, "Wed, 01 Jan 2025 00:02:00 GMT").when(i % 5 == 2, "Tue, 31 Dec 2024 23:00:00 GMT").when(i % 5 == 3, "soon").otherwise(F.lit(None).cast("string"))
    return events(spark, d).select("event_id", crawl.retry_after(v, F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("seconds"))


def polite_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Starts with each request's own gap."""
    x = _log(spark, d).select("host", F.col("event_id").alias("id"), (F.unix_micros("ts") / 1e6).alias("arrival"))
    return crawl.schedule_by(x, F.lit(300.0) + (F.col("id") % 4) * 200.0).select("host", "id", F.round("start", 3).alias("start"))


def permanent_errors(spark: SparkSession, d: str) -> DataFrame:
    x = _log(spark, d).where("status >= 400").select(crawl.error_class(F.col("status")).alias("error_type"), F.concat("host", F.lit("/"), "event_id").alias("url"), crawl.may_retry(F.col("attempt"), F.col("status")).alias("retry_scheduled"))
    return crawl.permanent_urls(x).select("error_type", F.md5(F.array_join("urls", ",").cast("binary")).alias("urls_md5"))


def crawl_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Why the crawls of each host came back empty."""
    kinds = {"view": "URLPolicyError: private", "error": "Blocked by robots.txt", "click": "response exceeds 10 bytes"}
    m = F.lit("HTTP 404")
    for k, v in kinds.items():
        m = F.when(F.col("event_type") == k, v).otherwise(m)
    x = events(spark, d).select("event_type", m.alias("message"))
    parts = [crawl.diagnosis(x.where(F.col("event_type") == k)).select(F.lit(k).alias("event_type"), "diagnosis") for k in (*kinds, "none")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sliding(events(spark, d), "2 hours", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\nCrawl-delay: 2\n\nUser-agent: skein\nUser-agent: other\nDisallow: /de/\nAllow: /de/\nDisallow: /fr/*?page=\n"


def robots_decision(spark: SparkSession, d: str, agent: str = "webskein/1.0") -> DataFrame:
    u = pages(spark, d).select("page_id", urls.without_fragment(F.col("url")).alias("url")).withColumn("origin", F.concat_ws("://", urls.scheme(F.col("url")), urls.host(F.col("url"))))
    u = u.withColumn("path", F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")).dropDuplicates(["url"])
    robots = u.select("origin").distinct().select("origin", crawl.robots_groups(F.when(F.col("origin").startswith("https"), F.lit(ROBOTS)).otherwise("User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\n")).alias("groups"))
    return crawl.robots_decisions(u, robots, agent).select("url", "allowed")


def url_policy(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 10
    odd = F.when(i == 0, F.lit("http://127.0.0.1/")).when(i == 1, "http://user@h.com/").when(i == 2, "ftp://h.com/").when(i == 3, "http://localhost:8080/").when(i == 4, "https://h.com:99999/").when(i == 5, "http://10.1.2.3/x").when(i == 6, "http://8.8.8.8/").otherwise(F.col("url"))
    return crawl.policy(pages(spark, d).select("page_id", odd.alias("url"))).select("page_id", F.coalesce("refused", F.lit("none")).alias("refused"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a crawl log: status from the type, attempt from the id."""
    s = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, 503).when(F.col("event_id") % 3 == 1, 429).otherwise(404)).when(F.col("event_type") == "signup", 500).otherwise(200)
    return events(spark, d).select("event_id", "ts", "value", F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("host"), s.alias("status"), (1 + F.col("event_id") % 4).cast("int").alias("attempt"))


def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return crawl.status_histogram(_log(spark, d))


def failure_categories(spark: SparkSession, d: str) -> DataFrame:
    message = F.concat(F.when(F.col("status") == 200, "Connection timed out").when(F.col("status") == 404, "HTTP 404").when(F.col("status") == 429, "Rate limit").otherwise("Status 503 or so"), F.lit("!"))
    return _log(spark, d).groupBy(crawl.failure_category(message).alias("category"), crawl.error_class(F.col("status")).alias("error_class")).agg(F.count("*").alias("n"))


def retry_stats(spark: SparkSession, d: str) -> DataFrame:
    x = _log(spark, d).where("status >= 400")
    x = x.select(crawl.error_class(F.col("status")).alias("error_type"), F.concat("host", F.lit("/"), "event_id").alias("url"), crawl.may_retry(F.col("attempt"), F.col("status")).alias("retry_scheduled"), crawl.backoff(F.col("attempt"), F.col("status"), F.when(F.col("status") == 503, 5.0)).alias("retry_delay"))
    return crawl.retry_statistics(x).withColumn("mean_delay", F.round("mean_delay", 6))


def rate_limit_schedule(spark: SparkSession, d: str) -> DataFrame:
    x = _log(spark, d).select("host", F.col("event_id").alias("id"), (F.unix_micros("ts") / 1e6).alias("arrival"))
    return crawl.schedule(x, 900.0).select("host", "id", F.round("start", 3).alias("start"))


def request_intervals(spark: SparkSession, d: str) -> DataFrame:
    x = _log(spark, d).select("host", (F.unix_micros("ts") / 1e6).alias("start"))
    return crawl.intervals(x).withColumn("mean_interval", F.round("mean_interval", 4))


def crawl_progress(spark: SparkSession, d: str) -> DataFrame:
    x = crawl.progress(_log(spark, d), 20_000, F.col("status") < 400, F.col("event_id") / 10.0)
    return x.select("pages", "succeeded", "failed", *(F.round(c, 6).alias(c) for c in ("rate", "percent", "eta")))


def queue_states(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("status") >= 500, "failed").when(F.col("status") == 404, "active").when(F.col("status") == 429, "queued").otherwise("processed")
    return crawl.queue_states(_log(spark, d).withColumn("state", s))


def _records(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return p.select("url", F.lit("t").alias("title"), F.col("html").alias("text"), F.array(F.col("url")).alias("links"), F.create_map(F.lit("k"), (F.col("page_id") % 3).cast("string")).alias("metadata"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("crawled_at"), F.when(F.col("page_id") % 11 == 0, 700).otherwise(200).alias("status_code"), F.when(F.col("page_id") % 13 != 0, "text/html").alias("content_type"))


def record_problems(spark: SparkSession, d: str) -> DataFrame:
    return records.checked(_records(spark, d))[1].groupBy("problem").agg(F.count("*").alias("n"))


def record_keys(spark: SparkSession, d: str) -> DataFrame:
    """Distinct records of the table taken twice."""
    x = _records(spark, d)
    return x.union(x).select(records.record_key().alias("record_key")).groupBy("record_key").agg(F.count("*").alias("times"))


def bounded_output(spark: SparkSession, d: str) -> DataFrame:
    x = pages(spark, d).select((F.col("page_id") % 5).alias("query_id"), F.floor(F.col("page_id") / 5).cast("int").alias("rank"), "url")
    return records.bounded_json(x, 1500).groupBy("query_id").agg(F.count("*").alias("n"), F.max("used").alias("bytes"))


def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap tree over the page table: an index of five sitemaps, one of which names the index again."""
    p = pages(spark, d).select((F.col("page_id") % 5).alias("s"), "url")
    sets = p.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), "").alias("x"))
    sets = sets.select(F.concat(F.lit("s"), "s").alias("url"), F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", F.lit("</urlset>")).alias("xml"))
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>s{i}</loc></sitemap>" for i in range(5)) + "<sitemap><loc>index</loc></sitemap></sitemapindex>"
    root = spark.createDataFrame([("index", index)], "url string, xml string")
    return sitemap.expand(root.select("url"), root.union(sets), max_urls=None).select("url", "depth")


def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ingest.tumbling(events(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_session(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(events(spark, d), "12 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_PARTS = r"lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, rtrim(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:@]+)', 1)), '.') AS host"
LOG_SQL = "lg AS (SELECT event_id, ts, 'h' || (user_id % 7) AS host, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 503 WHEN 1 THEN 429 ELSE 404 END WHEN event_type = 'signup' THEN 500 ELSE 200 END AS status, 1 + event_id % 4 AS attempt FROM events)"
CLASS_SQL = "CASE WHEN status IN (408, 429, 500, 502, 503, 504) THEN 'transient' WHEN status BETWEEN 400 AND 599 THEN 'permanent' ELSE 'ok' END"
BFS_SQL = "WITH RECURSIVE g AS (SELECT page_id AS i, unnest([2 * page_id, 2 * page_id + 1]) AS j FROM pages), r(i, depth) AS (SELECT * FROM (VALUES (1::BIGINT, 0), (3::BIGINT, 0)) UNION SELECT g.j, depth + 1 FROM r JOIN g USING (i) WHERE depth < 6) SELECT 'https://h' || (i % 5) || '/' || i AS url, min(depth)::INT AS depth FROM r GROUP BY i"
ROBOTS_SQL = r"""WITH u AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages), p AS (SELECT url, starts_with(url, 'https') AS s, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS path FROM u),
r AS (SELECT * FROM (VALUES (false, '/en/', '^/en/', false), (false, '/en/1', '^/en/1', true), (false, '/*.html$', '^/.*\.html$', false), (true, '/de/', '^/de/', false), (true, '/de/', '^/de/', true), (true, '/fr/*?page=', '^/fr/.*\?page=', false)) v(s, pat, rx, allow)),
h AS (SELECT p.url, arg_max(allow, (length(pat), allow)) AS allow FROM p JOIN r ON p.s = r.s AND regexp_matches(path, rx) GROUP BY p.url)
SELECT url, coalesce(allow, true) AS allowed FROM p LEFT JOIN h USING (url)"""

#: Real links: src, dst of all pages, as page_links resolves them.
EDGES_SQL = r"""ea AS (SELECT url AS src, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS x FROM pages),
ed AS (SELECT DISTINCT src, regexp_replace(replace(CASE WHEN starts_with(x, '/') THEN origin || x ELSE x END, '&amp;', '&'), '#.*$', '') AS dst FROM ea)"""
WALK_SQL = rf"""WITH RECURSIVE {EDGES_SQL}, fp AS (SELECT arg_min(url, page_id) AS url FROM (SELECT page_id, url, {_PARTS} FROM pages) GROUP BY host),
r(url, depth) AS (SELECT url, 0 FROM fp UNION SELECT ed.dst, depth + 1 FROM r JOIN ed ON ed.src = r.url WHERE depth < 50) SELECT url, min(depth)::INT AS depth FROM r GROUP BY url"""

QUERIES = {
    f.__name__: f
    for f in (
        url_parts, same_origin_links, domain_top10, link_admission, link_frontier_bfs, frontier_fair, robots_decision, url_policy, status_histogram, failure_categories, retry_stats, rate_limit_schedule, request_intervals, crawl_progress,
        queue_states, record_problems, record_keys, bounded_output, sitemap_urls, event_tumbling, event_session, crawl_walk, frontier_tree, frontier_states, origins, robots_cached, retry_waits, polite_schedule, permanent_errors, crawl_diagnosis,
        event_sliding,
    )
}
ORACLES = {
    "url_parts": f"SELECT page_id, regexp_replace(url, '#.*$', '') AS normal, {_PARTS}, CASE WHEN starts_with(lower(url), 'https') THEN 443 ELSE 80 END AS port, true AS is_http FROM pages",
    "same_origin_links": rf"""WITH {EDGES_SQL}, x AS (SELECT url, link FROM (SELECT DISTINCT page_id, url, regexp_replace(replace(CASE WHEN starts_with(x, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || x ELSE x END, '&amp;', '&'), '#.*$', '') AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS x FROM pages)))
SELECT host, count(*) AS links, count(*) FILTER (WHERE lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) = lower(regexp_extract(link, '^[A-Za-z]+://[^/?#]*'))) AS same_origin FROM (SELECT url, link, {_PARTS} FROM x) GROUP BY host""",
    "domain_top10": f"SELECT host AS domain, count(*) AS n, min(page_id) AS first_seen FROM (SELECT page_id, {_PARTS} FROM pages) GROUP BY host ORDER BY n DESC, first_seen LIMIT 10",
    "link_admission": r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '\.example\.(com|net)/') AND NOT regexp_matches(url, 'utm_source') AND NOT regexp_matches(url, 'ads-')",
    "link_frontier_bfs": WALK_SQL,
    "frontier_tree": BFS_SQL,
    "crawl_walk": rf"""WITH {EDGES_SQL}, s AS (SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '\.example\.(com|net)/')), n AS (SELECT DISTINCT dst AS url FROM ed JOIN s ON s.url = ed.src WHERE regexp_matches(dst, '\.example\.(com|net)/') AND dst NOT IN (SELECT url FROM s))
SELECT url, 0::INT AS depth, 200 AS status FROM s UNION ALL SELECT url, 1::INT, CASE WHEN url IN (SELECT url FROM pages) THEN 200 ELSE 404 END FROM n""",
    "frontier_states": "WITH q AS (SELECT url, min(page_id) AS i FROM pages GROUP BY url), a AS (SELECT *, row_number() OVER (ORDER BY i) <= 100 AS active FROM q) SELECT count(*) FILTER (WHERE NOT active OR i % 2 = 1) AS queued, 0::BIGINT AS active, count(*) FILTER (WHERE active AND i % 4 = 0) AS processed, count(*) FILTER (WHERE active AND i % 4 = 2) AS failed FROM a",
    "origins": f"SELECT page_id, scheme || '://' || host AS origin, scheme || '://' || host || '/robots.txt' AS robots FROM (SELECT page_id, {_PARTS} FROM pages)",
    "robots_cached": f"SELECT DISTINCT o AS origin, CASE WHEN length(o) % 2 = 0 THEN 'cached' ELSE 'fetched' END AS rules, CASE WHEN length(o) % 2 = 0 THEN 9000.0 ELSE 10000.0 END::DOUBLE AS at FROM (SELECT scheme || '://' || host AS o FROM (SELECT {_PARTS} FROM pages))",
    "retry_waits": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 100 + 0.5 WHEN 1 THEN 120 ELSE 0 END::DOUBLE AS seconds FROM events",
    "polite_schedule": f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT host, event_id AS id, epoch_us(ts) / 1e6 AS a, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS i FROM lg),
s(host, i, id, start) AS (SELECT host, i, id, a FROM o WHERE i = 1 UNION ALL SELECT o.host, o.i, o.id, greatest(o.a, s.start + 300 + o.id % 4 * 200) FROM s JOIN o ON o.host = s.host AND o.i = s.i + 1) SELECT host, id, round(start, 3) AS start FROM s""",
    "permanent_errors": f"WITH {LOG_SQL}, x AS (SELECT {CLASS_SQL} AS error_type, host || '/' || event_id AS url FROM lg WHERE status >= 400 AND NOT (status IN (429, 500, 503) AND attempt < CASE WHEN status = 500 THEN 2 ELSE 4 END)) SELECT error_type, md5(array_to_string(list_sort(list(url)), ',')) AS urls_md5 FROM x GROUP BY error_type",
    "crawl_diagnosis": """SELECT * FROM (VALUES ('view', 'crawl was blocked by the configured URL network policy'), ('error', 'site access is blocked by robots.txt'), ('click', 'crawl response exceeded the server byte limit')) v(event_type, diagnosis) WHERE event_type IN (SELECT event_type FROM events)
UNION ALL SELECT 'none', 'crawl returned no indexable pages; verify the URL, robots.txt, and site availability'""",
    "event_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL",
    "robots_decision": ROBOTS_SQL,
    "url_policy": "SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'address' WHEN 1 THEN 'credentials' WHEN 2 THEN 'scheme' WHEN 3 THEN 'local name' WHEN 4 THEN 'port' WHEN 5 THEN 'address' ELSE 'none' END AS refused FROM pages",
    "status_histogram": f"WITH {LOG_SQL} SELECT status, count(*) AS n FROM lg GROUP BY status",
    "failure_categories": f"WITH {LOG_SQL} SELECT CASE status WHEN 200 THEN 'timeout' WHEN 404 THEN 'not found' WHEN 429 THEN 'rate limited' ELSE 'server error' END AS category, {CLASS_SQL} AS error_class, count(*) AS n FROM lg GROUP BY ALL",
    "retry_stats": f"""WITH {LOG_SQL}, x AS (SELECT {CLASS_SQL} AS error_type, host || '/' || event_id AS url, status IN (429, 500, 503) AND attempt < CASE WHEN status = 500 THEN 2 ELSE 4 END AS retry, greatest(CASE WHEN status = 429 THEN 2 ELSE 1 END * least(30, 0.5 * 2.0 ** (attempt - 1)), CASE WHEN status = 503 THEN 5.0 ELSE 0 END) AS delay FROM lg WHERE status >= 400)
SELECT error_type, count(*) AS errors, count(*) FILTER (WHERE retry) AS retries, round(avg(delay) FILTER (WHERE retry), 6) AS mean_delay, count(DISTINCT url) FILTER (WHERE NOT retry) AS permanent_urls FROM x GROUP BY error_type""",
    "rate_limit_schedule": f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT host, event_id AS id, epoch_us(ts) / 1e6 AS a, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS i FROM lg),
s(host, i, id, start) AS (SELECT host, i, id, a FROM o WHERE i = 1 UNION ALL SELECT o.host, o.i, o.id, greatest(o.a, s.start + 900) FROM s JOIN o ON o.host = s.host AND o.i = s.i + 1) SELECT host, id, round(start, 3) AS start FROM s""",
    "request_intervals": f"WITH {LOG_SQL}, x AS (SELECT host, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY host ORDER BY ts) AS dt FROM lg) SELECT host, count(*) AS n, round(avg(dt), 4) AS mean_interval FROM x GROUP BY host",
    "crawl_progress": f"WITH {LOG_SQL}, x AS (SELECT count(*) AS pages, count(*) FILTER (WHERE status < 400) AS succeeded, count(*) FILTER (WHERE status >= 400) AS failed, max(event_id / 10.0::DOUBLE) AS s FROM lg) SELECT pages, succeeded, failed, round(pages / s, 6) AS rate, round(100.0::DOUBLE * pages / 20000, 6) AS percent, round(greatest(0, 20000 - pages) / (pages / s), 6) AS eta FROM x",
    "queue_states": f"WITH {LOG_SQL} SELECT count(*) FILTER (WHERE status = 429) AS queued, count(*) FILTER (WHERE status = 404) AS active, count(*) FILTER (WHERE status = 200) AS processed, count(*) FILTER (WHERE status >= 500) AS failed FROM lg",
    "record_problems": "SELECT CASE WHEN page_id % 13 = 0 THEN 'missing content_type' ELSE 'status out of range' END AS problem, count(*) AS n FROM pages WHERE page_id % 13 = 0 OR page_id % 11 = 0 GROUP BY 1",
    "record_keys": "SELECT sha256(url || chr(0) || 't' || chr(0) || html || chr(0) || url || chr(0) || 'k=' || (page_id % 3) || chr(0) || '2024-01-01T00:00:00.000000Z' || chr(0) || CASE WHEN page_id % 11 = 0 THEN 700 ELSE 200 END || chr(0) || CASE WHEN page_id % 13 <> 0 THEN 'text/html' ELSE '' END) AS record_key, 2 * count(*) AS times FROM pages GROUP BY 1",
    "bounded_output": """WITH j AS (SELECT page_id % 5 AS query_id, page_id // 5 AS rank, strlen('{"rank":' || (page_id // 5) || ',"url":"' || url || '"}') AS b FROM pages), c AS (SELECT *, sum(b) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM j) SELECT query_id, count(*) AS n, max(used)::BIGINT AS bytes FROM c WHERE used <= 1500 GROUP BY query_id""",
    "sitemap_urls": "SELECT DISTINCT url, 1::INT AS depth FROM pages",
    "event_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_session": """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k""",
}
