"""The engine's object, reports and command line end to end."""

import functools
import io
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from webskein import cli, report, serving
from webskein.catalogue import evaluation
from webskein.config import CrawlConfig
from webskein.engine import Engine
from webskein.operators import fusion, semantic

PAGES = [
    (1, "https://h.com/a", "<title>Retries</title><h1>Retries</h1><p>Requests are retried with growing pauses.</p><h2>Limits</h2><p>Three attempts at most.</p>"),
    (2, "https://h.com/b", "<title>Storage</title><p>Rows are written in batches. Retries are not needed.</p>"),
    (3, "https://h.com/c", "<title>Storage</title><p>Rows are written in batches. Retries are not needed.</p>"),
]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.index_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    return e


def test_search_and_context(spark, engine):
    hits = engine.search(engine.queries("How are retries limited?", "", "zzz"), 5)
    rows = hits.orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {"q1"} and [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].document_title == "Retries" and all(r.canonical_url != "https://h.com/c" for r in rows)  # the smaller url is the source
    c = engine.build_context(hits, 20).first()
    assert c.used_tokens <= 20 and c.n_selected == len(c.chunks) >= 1
    with pytest.raises(ValueError):
        engine.search(engine.queries("x"), 0)


def test_semantic_and_hybrid(spark, engine):
    keys = sorted(r.chunk_hash for r in engine.store.read("chunks").collect())
    vectors = spark.createDataFrame([(k, [float(i == j) for j in range(len(keys))]) for i, k in enumerate(keys)], "key string, vector array<float>")
    q = spark.createDataFrame([("q1", [1.0] + [0.0] * (len(keys) - 1))], "query_id string, vector array<float>")
    assert engine.search_semantic(vectors, q, 1).first().chunk_hash == keys[0]
    assert engine.search_hybrid(engine.queries("retries"), vectors, q, 2, 10).count() == 2
    with pytest.raises(RuntimeError):
        engine.search_semantic(vectors.limit(1), q)
    with pytest.raises(ValueError):
        engine.search_hybrid(engine.queries("x"), vectors, q, 5, 2)


def test_embedding_table_follows_the_store(spark, engine):
    make = functools.partial(semantic.HashedWords, 32)
    first = engine.embed(make)
    assert first.count() == engine.store.read("chunks").count() and engine.readiness(first).first().ready
    q = semantic.embedded(spark.createDataFrame([("q1", "retried pauses")], "chunk_hash string, text string"), make).select(F.col("chunk_hash").alias("query_id"), "vector")
    assert "retried" in engine.search_semantic(first, q, 1).first().text
    engine.index_pages(spark.createDataFrame([(1, "https://h.com/a", "<p>Something new.</p>")], "page_id long, url string, html string"))
    assert not engine.readiness(first).first().ready
    with pytest.raises(RuntimeError):
        engine.search_semantic(first, q)
    again = engine.embed(make, first)
    assert engine.readiness(again).first().ready and again.count() == engine.store.read("chunks").count()
    with pytest.raises(fusion.RetrievalError) as e:
        engine.search_hybrid(engine.queries("x"), again.select("key"), q)
    assert e.value.strategy == "semantic"


def test_crawl_and_tools(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    site = {"https://h.com/": "<p>Home of retries.</p><a href='/a'>a</a><a href='/no'>n</a><a href='http://127.0.0.1/'>x</a>", "https://h.com/a": "<p>About storage.</p>", "https://h.com/no": "<p>secret</p>", "https://h.com/robots.txt": "User-agent: *\nDisallow: /no"}
    pages = spark.createDataFrame(list(site.items()), "url string, html string")
    fetch = lambda u: u.join(pages, "url", "left").select("url", F.when(F.col("html").isNull(), 404).otherwise(200).alias("status"), "html", F.lit(None).cast("string").alias("problem"))
    (tmp_path / "c.json").write_text(json.dumps({"max_depth": 2, "domains": ["h.com", "127.0.0.1"]}))
    config = CrawlConfig.from_file(str(tmp_path / "c.json"))
    got = {r.url: r.problem or r.status for r in e.crawl(spark.createDataFrame([("https://h.com/",)], "url string"), config, fetch).collect()}
    assert got == {"https://h.com/": 200, "https://h.com/a": 200, "https://h.com/no": "Blocked by robots.txt"}
    for bad in ({"max_pages": 0}, {"what": 1}, {"domains": [1]}, {"retries": "3"}):
        with pytest.raises(ValueError):
            CrawlConfig.of(bad)
    asked = [{"id": 1, "method": "tools/list"}, {"id": 2, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "retries"}}}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": " "}}}, {"id": 4, "method": "tools/call", "params": {"name": "info"}}]
    out = io.StringIO()
    serving.serve(e, io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [t["name"] for t in said[0]["result"]] == ["search", "context", "info", "fetch"] and said[1]["result"][0]["text"].startswith("Home of retries")
    assert "needed" in said[2]["error"]["message"] and said[3]["result"]["documents"] == 2 and said[4]["error"]
    chunk = said[1]["result"][0]
    key = e.store.read("chunks").where(F.col("text") == chunk["text"]).first().chunk_hash
    assert serving.Tools(e).fetch({"chunk_hash": key})["text"] == chunk["text"] and serving.Tools(e, 40).search({"query": "retries"}) == []
    assert serving.Tools(e).context({"query": "storage", "budget": 5})["used_tokens"] <= 5


def test_reports_of_crawls_and_evaluations(spark, tmp_path):
    log = spark.createDataFrame([("https://a/1", 200, 1, 1.0, 1), ("https://a/2", 503, 1, 2.0, 2), ("https://b/1", 404, 1, 3.0, 3)], "url string, status int, attempt int, seconds double, page_id long")
    report.crawl_report(str(tmp_path / "c.json"), log, 6)
    said = json.loads((tmp_path / "c.json").read_text())
    assert said["Progress"] == [{"pages": 3, "succeeded": 1, "failed": 2, "rate": 1.0, "percent": 50.0, "eta": 3.0}] and [e["errors"] for e in said["Errors"]] == [1, 1] and said["Domains"][0]["n"] == 2
    sf = SF
    m = evaluation.outcome_rows(spark, sf)
    report.evaluation_report(str(tmp_path / "e.md"), "BM25", m.where("strategy = 'bm25'").drop("strategy", "failed"), evaluation.query_rows(spark, sf), evaluation.judged_items(spark, sf).where("strategy = 'bm25'").join(evaluation.query_rows(spark, sf).select("query_id", "n_relevant", "irrelevant_share"), "query_id"), spark.createDataFrame([(0, 0.5), (1, 1.5)], "repeat int, seconds double"), ["one warning"])
    text = (tmp_path / "e.md").read_text()
    assert all(f"## {x}" in text for x in ("Means", "Categories", "Latency", "Strongest queries", "Worst queries", "False positives")) and "one warning" in text and "| 2 | 1.0000 |" in text
    report.comparison_report(str(tmp_path / "p.html"), "Two", m, ("bm25", "hybrid"), evaluation.outcome_classes(spark, sf))
    assert "<h2>Classes</h2>" in (tmp_path / "p.html").read_text() and "<h2>Differences</h2>" in (tmp_path / "p.html").read_text()


def test_reports_and_command_line(spark, tmp_path, capsys):
    df = spark.createDataFrame([("a|b", 0.5, None)], "name string, x double, y int")
    for kind in ("md", "html", "json"):
        report.write(str(tmp_path / f"r.{kind}"), "T", {"S": df})
    assert "| a\\|b | 0.5000 | - |" in (tmp_path / "r.md").read_text() and json.loads((tmp_path / "r.json").read_text())["S"] == [{"name": "a|b", "x": 0.5, "y": None}]
    with pytest.raises(ValueError):
        report.rows_of(spark.range(report.ROWS + 1))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    store = f"file://{tmp_path}/s"
    assert cli.main(["index", store, str(tmp_path / "pages")]) == 0
    assert cli.main(["search", store, "retries", "--limit", "1"]) == 0 and '"rank": 1' in capsys.readouterr().out
    assert cli.main(["embed", store, str(tmp_path / "v")]) == 0 and cli.main(["search", store, "retries", "--vectors", str(tmp_path / "v")]) == 0 and '"rank": 1' in capsys.readouterr().out
    assert cli.main(["embed", store, str(tmp_path / "v")]) == 0 and cli.main(["search", store, "retries", "--vectors", str(tmp_path / "v"), "--hybrid"]) == 0
    assert cli.main(["info", store]) == 0 and cli.main(["search", store, "x", "--limit", "0"]) == 2
