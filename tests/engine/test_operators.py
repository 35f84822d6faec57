"""Operators on small inputs with results worked out by hand, and state changes of the store."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from webskein.catalogue import crawling
from webskein.functions import text as T
from webskein.functions import urls as U
from webskein.operators import chunk, compare, context, crawl, evaluate, fusion, html, lexical, semantic
from webskein.operators.store import Store
from webskein.sources import datasets, http, records, sitemap
from webskein.streaming import ingest


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


# text


def test_query_tokens(spark):
    assert one(spark, T.query_tokens(F.lit("How are C++ and c++, Retry-After v1.2 C# café?"))) == ["How", "are", "C++", "and", "Retry-After", "v1.2", "C#", "café"]
    assert one(spark, T.query_tokens(F.lit(" ?! "))) == []


def test_folding_equals_the_full_text_index(spark):
    words = ["Éclair", "naïve", "straße", "ộ", "Ünï", "ﬁn", "x²", "Ωμέγα", "Å"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    con.execute("INSERT INTO t VALUES (?)", (" ".join(words[:7]),))
    assert sorted(one(spark, T.tokens(F.lit(" ".join(words[:7]))))) == sorted(r[0] for r in con.execute("SELECT term FROM v"))


def test_bm25_equals_the_full_text_index(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *(" ".join(f"w{int(x)}" for x in rng.zipf(1.6, n) if x < 60) for n in (40, 4, 3))) for i in range(120)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, c)")
    con.executemany("INSERT INTO t(rowid, a, b, c) VALUES (?, ?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    q = {"q1": "w5 w9", "q2": "w1 w30", "q3": "w2-w3 w7"}
    got = lexical.bm25(lexical.build(lexical.tokenised(df, "id", "a", "b", "c")), lexical.parsed(spark.createDataFrame(list(q.items()), "query_id string, query string")))
    got = {(r.query_id, r.key): r.score for r in got.collect()}
    want = {}
    for k, text in q.items():
        match = " OR ".join(f'"{x}"' for x in text.split())
        want |= {(k, i): s for i, s in con.execute("SELECT rowid, bm25(t, 1.0, 5.0, 3.0) FROM t WHERE t MATCH ?", (match,))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-10) for k in want)


def test_slices_overlap_evidence(spark):
    assert one(spark, T.slices(F.lit("abcdefg"), 3)) == ["abc", "def", "g"] and one(spark, T.slices(F.lit(""), 3)) == []
    assert one(spark, T.overlap_suffix(F.lit("alpha beta gamma delta"), 12)) == "gamma delta"
    assert one(spark, T.evidence(F.lit("  A  b ,c\n !"))) == "a b,c!"
    assert one(spark, T.digest(F.lit("a"), F.lit(None), F.lit("b"))) != one(spark, T.digest(F.lit("a"), F.lit("b"), F.lit(None)))


# html


def test_clean_page():
    page = """<html><head><title> A  B </title><link rel="canonical" href="/c#x"></head><body><nav>no</nav><div class="menu-article">kept <b>bold</div><div id="main-nav">no</div>
    <h1>Top</h1><p>one <a href="x?y#z">link</a> two<p>three<br>four <code>a`b</code><h2>Sub</h2><ul><li>i1<ol><li>n1<li>n2</ol><li>i2</ul><pre>
  x
    y

</pre><table><tr><th>h|1<th>h2<tr><td>c1</table><script>var a = "</p>"</script><footer>no</footer>"""
    d = html.clean(page, "https://h.com/a/")
    assert (d["title"], d["canonical_url"]) == ("A B", "https://h.com/c")
    assert [(b["kind"], b["text"], b["heading_path"]) for b in d["blocks"]] == [
        ("paragraph", "kept bold", []), ("heading", "Top", ["Top"]), ("paragraph", "one link two", ["Top"]), ("paragraph", "three four a`b", ["Top"]), ("heading", "Sub", ["Top", "Sub"]),
        ("list", "- i1\n  1. n1\n  2. n2\n- i2", ["Top", "Sub"]), ("code", "  x\n    y", ["Top", "Sub"]), ("table", "h|1 | h2\nc1 | ", ["Top", "Sub"]),
    ]
    by = {b["text"]: b["markdown"] for b in d["blocks"]}
    assert by["one link two"] == "one [link](https://h.com/a/x?y) two" and by["three four a`b"] == "three four ``a`b``" and by["h|1 | h2\nc1 | "].startswith("| h\\|1 | h2 |\n| --- | --- |")
    assert html.clean("", "nowhere") == {"effective_url": None, "canonical_url": "", "title": "", "blocks": []}


def test_structured_page():
    page = '<title>T</title><meta name="Description" content=" d  e "><body><a href="../x#f">1</a><a href="//o.com/y">2</a><a href="/x">3</a><a href="mailto:a@b">4</a><a href="http://h:bad/">5</a><img src="i.png" alt=" a  b "><h2>H</h2><ul><li>a<ul><li>b</ul><li>c</ul>'
    d = html.structured(page, "https://h.com/a/b")
    assert d["links"] == ["https://h.com/x", "https://o.com/y"] and d["metadata"]["description"] == "d e" and d["images"] == [{"src": "https://h.com/a/i.png", "alt": "a b"}]
    assert d["headings"] == [{"level": 2, "text": "H"}] and d["lists"] == [{"type": "ul", "items": ["a", "c"]}, {"type": "ul", "items": ["b"]}]


# chunks


def chunked(spark, blocks, target, hard, overlap=0):
    rows = [("d", i, k, t, list(p)) for i, (k, t, p) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "document_id string, pos int, kind string, text string, heading_path array<string>")
    c = chunk.chunks(df, spark.createDataFrame([("d", "u", "t")], "document_id string, source_url string, title string"), chunk.ChunkConfig(target, hard, overlap))
    return [(r.text, r.heading_path) for r in c.orderBy("ordinal").collect()]


def test_chunks(spark):
    p = lambda t, *path: ("paragraph", t, path)
    assert chunked(spark, [("heading", "A", ["A"]), p("body", "A")], 100, 120) == [("A\n\nbody", ["A"])]
    assert [x[1] for x in chunked(spark, [p("a" * 40, "A"), p("b" * 40, "A"), p("c", "B"), p("d", "A")], 70, 100)] == [["A"], ["A"], ["B"], ["A"]]
    two = chunked(spark, [p("alpha beta gamma delta epsilon"), p("zeta eta theta iota kappa")], 45, 90, 16)
    assert two[1][0].startswith("delta epsilon\n\nzeta")
    long = chunked(spark, [p("One sentence here. " * 12 + "x" * 132)], 45, 55)
    assert len(long) > 3 and all(len(t) <= 55 for t, _ in long) and "".join(t for t, _ in long).count("x") == 132
    assert chunked(spark, [p("y" * 80)], 40, 80) == [("y" * 80, [])]
    code = [t for t, _ in chunked(spark, [("code", "  first\n" + "z" * 75 + "\n  last", [])], 25, 30)]
    assert code == ["  first", "z" * 30, "z" * 30, "z" * 15 + "\n\n  last"]
    assert chunked(spark, [("heading", "A", ["A"]), p("  ")], 1200, 1600) == []
    with pytest.raises(ValueError):
        chunk.ChunkConfig(10, 5, 0)


# vectors, fusion, context


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(semantic.cosine("a", "b", normalised=False)).collect()] == [1.0, pytest.approx(0.96)]
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0], [1.0])], "a array<float>, b array<float>").select(semantic.cosine("a", "b", normalised=False)).collect()


def test_fusion(spark):
    rows = [("q", "bm25", 1.0, k, i + 1, 0.0) for i, k in enumerate("ABC")] + [("q", "semantic", 1.0, k, i + 1, 0.0) for i, k in enumerate("CAD")]
    df = spark.createDataFrame(rows, "query_id string, strategy string, weight double, key string, rank int, raw_score double")
    got = fusion.fuse(df).orderBy("rank").collect()
    assert [r.key for r in got] == ["A", "C", "B", "D"] and got[0].score == pytest.approx(0.03252247488101534)
    tie = [("q", "semantic", 1.0, "D", 1, 0.0), ("q", "bm25", 1.0, "B", 1, 0.0)]
    assert [r.key for r in fusion.fuse(spark.createDataFrame(tie, df.schema)).orderBy("rank").collect()] == ["B", "D"]
    with pytest.raises(ValueError):
        fusion.fuse(df, limit=0)


def test_context_passes_over_what_does_not_fit(spark):
    rows = [("q", i + 1, f"h{i}", f"d{i}", n, n) for i, n in enumerate((100, 900, 50, 860, 40))] + [("q", 6, "h0", "d9", 100, 100)]
    df = spark.createDataFrame(rows, "query_id string, rank int, content_hash string, document_id string, n_tokens long, source_tokens long")
    r = context.select_context(df, 1000).first()
    assert (r.candidates, r.n_selected, r.used_tokens) == (6, 2, 1000) and [s.rank for s in r.selected] == [1, 2]


# evaluation


def test_metrics_by_hand(spark):
    g = spark.createDataFrame([("q", i + 1, x) for i, x in enumerate((3, 0, 2, 0))], "query_id string, rank int, grade int")
    j = spark.createDataFrame([("q", 3), ("q", 2), ("q", 0)], "query_id string, relevance int")
    m = {r.k: r for r in evaluate.metrics(spark.createDataFrame([("q",), ("n",)], "query_id string"), g, j, (1, 3, 4)).where("query_id = 'q'").collect()}
    assert (m[1].precision, m[3].precision, m[4].precision) == (1, pytest.approx(2 / 3), 0.5) and (m[1].recall, m[3].recall) == (0.5, 1)
    assert m[4].ap == pytest.approx(5 / 6) and m[4].rr == 1 and m[4].ndcg == pytest.approx(0.95583058934618)


def test_crediting_is_greedy_and_once(spark):
    r = spark.createDataFrame([("q", i) for i in (1, 2, 3)], "query_id string, rank int")
    m = spark.createDataFrame([("q", 1, "a", 1), ("q", 1, "b", 3), ("q", 2, "b", 3), ("q", 2, "a", 1), ("q", 3, "b", 3)], "query_id string, rank int, judgment_id string, relevance int")
    assert [(x.rank, x.grade, x.judgment_id) for x in evaluate.credited(r, m).orderBy("rank").collect()] == [(1, 3, "b"), (2, 1, "a"), (3, 0, None)]


def test_candidates_match_by_id_or_url(spark):
    r = spark.createDataFrame([("q", 1, "d1", "u1", "s", ["H"], "The  Text, here ."), ("q", 2, "x", "u2", None, None, "other")], "query_id string, rank int, document_id string, canonical_url string, section_id string, heading_path array<string>, text string")
    j = spark.createDataFrame([("q", "j1", "d1", "u9", "s", ["H"], "text, here.", 3), ("q", "j2", "d9", "u2", None, None, None, 1), ("q", "j3", "d1", None, "t", None, None, 1), ("q", "j4", "d1", "u1", None, None, None, 0)], "query_id string, judgment_id string, document_id string, canonical_url string, section_id string, heading_path array<string>, evidence string, relevance int")
    assert sorted((x.rank, x.judgment_id) for x in evaluate.candidates(r, j).collect()) == [(1, "j1"), (2, "j2")]


def test_bootstrap_and_percentiles(spark):
    assert compare.percentile([1.0, 2.0, 3.0, 4.0], 0.5) == 2.5 and compare.resampled([], 10, 1) == (0.0, 0.0, 0.0)
    df = spark.createDataFrame([("m", i, float(i % 3)) for i in range(60)], "metric string, query_id int, delta double")
    a, b = compare.bootstrap(df, 2000).first(), compare.bootstrap_distributed(df, 2000).first()
    assert a.mean == b.mean == 1.0 and abs(a.low - b.low) < 0.05 and abs(a.high - b.high) < 0.05 and compare.bootstrap(df, 500).first() == compare.bootstrap(df, 500).first()


def test_latency(spark):
    r = evaluate.latency(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, 20.0)], "v double"), "v").first()
    assert (r["mean"], r["median"], r["p95"], r["max"]) == (6, 3, 20, 20)


# store and streams


def page(i, body, url=None):
    return (i, url or f"https://h.com/{i}", f"<title>t</title><body><p>{body}</p></body>")


def test_store_states(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    put = lambda seq, *ps: s.index(*ingest.batch_of(spark.createDataFrame(list(ps), "page_id long, url string, html string"), seq=seq))
    assert put(1, page(1, "alpha"), page(2, "alpha"), page(3, "beta")) == {"documents": 3, "new_contents": 2, "duplicate_contents": 1, "chunks": 3, "new_chunks": 2, "duplicate_chunks": 1}
    assert put(2, page(1, "alpha"))["new_contents"] == 0
    put(3, page(3, "gamma"))  # beta is an orphan now; alpha is shared and stays
    assert sorted(r.text for r in s.read("chunks").collect()) == ["alpha", "gamma"] and {k: v for k, v in s.info().first().asDict().items() if "session" not in k and "finished" not in k} == {"documents": 3, "cleaned_tokens": 6, "contents": 2, "chunks": 2}
    assert s.history().count() == 3 and s.info().first().latest_session == s.version()
    before = s.version()
    bad = ingest.batch_of(spark.createDataFrame([page(9, "x")], "page_id long, url string, html string"))
    with pytest.raises(ValueError):
        s.index(bad[0].limit(0), bad[1], bad[2])
    assert s.version() == before


def test_store_appends_and_compacts(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    put = lambda *ps: s.index(*ingest.batch_of(spark.createDataFrame(list(ps), "page_id long, url string, html string")))
    texts = lambda at: sorted(r.text for r in at.read("chunks").collect())
    put(page(1, "one"), page(2, "two"))
    first = s.snapshot()
    for k in range(3, 6):
        put(page(1, f"one {k}"))
    assert len(s.snapshot().parts["documents"]) == 4 and all(len(p) == 4 for p in s.snapshot().parts.values())  # a batch adds its own rows only
    assert texts(first) == ["one", "two"] and texts(s.snapshot()) == ["one 5", "two"]  # what was opened before stays as it was
    put(page(1, "one"))  # a content that was dead lives again
    assert texts(s.snapshot()) == ["one", "two"] and sorted(r.text for r in s.read("contents").collect()) == ["one", "two"]
    s.compact()
    assert all(len(p) == 1 for p in s.snapshot().parts.values()) and texts(s.snapshot()) == ["one", "two"]
    assert s.info().first().documents == 2 and put(page(3, "two"))["duplicate_contents"] == 1


def test_store_reads_pointers_of_the_first_format(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    d, c, k = ingest.batch_of(spark.createDataFrame([page(1, "old")], "page_id long, url string, html string"))
    for name, df in (("documents", d), ("contents", c), ("chunks", k.select("chunk_hash", "text", "title", "heading", "n_tokens")), ("content_chunks", k.select("content_hash", F.col("ordinal").cast("int").alias("ordinal"), "chunk_hash"))):
        df.write.parquet(str(tmp_path / "store" / "v1" / name))
    (tmp_path / "store" / "pointers").mkdir()
    (tmp_path / "store" / "pointers" / "0000000000-v1").write_text('{"schema": 1, "documents": 1}')
    assert [r.text for r in s.read("chunks").collect()] == ["old"]
    s.index(*ingest.batch_of(spark.createDataFrame([page(2, "new")], "page_id long, url string, html string")))
    assert sorted(r.text for r in s.read("chunks").collect()) == ["new", "old"]
    (tmp_path / "store" / "pointers" / "9999999999-v9").write_text('{"schema": 9}')
    with pytest.raises(ValueError):
        s.snapshot()


class Failing(semantic.HashedWords):
    def embed(self, texts):
        if "bad" in texts:
            raise RuntimeError("out of memory")
        return super().embed(texts)


def test_embedding_goes_on_after_a_failed_batch(spark):
    df = spark.createDataFrame([(str(i), "bad" if i == 5 else f"text {i}") for i in range(8)], "chunk_hash string, text string").coalesce(1)
    got = {r.chunk_hash: r for r in semantic.embedded(df, lambda: Failing(8), batch=2).collect()}
    assert [k for k in sorted(got) if got[k].error] == ["4", "5"] and got["4"].error == "RuntimeError: out of memory" and got["0"].size == 2
    assert sum(x * x for x in got["7"].vector) == pytest.approx(1.0, abs=1e-6)
    assert semantic.embedded(df.limit(0), lambda: Failing(8)).count() == 0


def test_readiness_looks_for_each_chunk(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_hash string")
    v = spark.createDataFrame([("a", [1.0], "m"), ("gone", [1.0], "m")], "chunk_hash string, vector array<float>, model_fingerprint string")
    r = semantic.readiness(chunks, v, "m").first()
    assert (r.ready, r.n_missing, r.n_stale) == (False, 1, 1)
    after = semantic.stored(v, spark.createDataFrame([("b", [1.0])], "chunk_hash string, vector array<float>"), chunks, "m", 1)
    assert sorted(x.chunk_hash for x in after.collect()) == ["a", "b"] and semantic.readiness(chunks, after, "m").first().ready
    with pytest.raises(Exception, match="must not be empty"):
        spark.range(1).select(semantic.query_text(F.lit(" \n"))).collect()


def test_runner_isolates_failures_and_sees_unstable_orders(spark):
    q = spark.createDataFrame([("a", "x"), ("b", "boom"), ("c", "y")], "query_id string, query string")
    calls = []

    def search(df):
        calls.append(df)
        if not df.where("query = 'boom'").isEmpty():
            raise RuntimeError("boom")
        turn = len(calls) % 2
        return df.select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).withColumn("key", (F.col("rank") + turn) % 2)

    got, samples, said = evaluate.run_queries(q, search)
    assert {(r.query_id, r.failed) for r in got.collect()} == {("a", False), ("b", True), ("c", False)} and samples.count() == 0 and "b: RuntimeError" in said
    got, samples, said = evaluate.run_queries(q.where("query_id <> 'b'"), search, repeats=2)
    assert samples.count() == 2 and said == ["repeat 1 ranks 2 queries in another order"] and got.count() == 4


def test_crawl_loop(spark):
    site = {"https://h.com/": "<a href='/a'>a</a><a href='https://other.org/'>o</a>", "https://h.com/a": "<a href='/'>home</a><a href='/b'>b</a><a href='/skip'>s</a>", "https://h.com/b": "<a href='/c'>c</a>", "https://h.com/c": ""}
    pages = spark.createDataFrame(list(site.items()), "url string, html string")
    fetch = lambda u: u.join(pages, "url", "left").select("url", F.when(F.col("html").isNotNull(), 200).otherwise(404).alias("status"), "html", F.lit(None).cast("string").alias("problem"))
    saved, tries = [], []

    def save(df):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("once")
        saved.extend(r.url for r in df.collect())

    admit = lambda df: crawl.admitted(df, domains=["h.com"], exclude=["/skip"])
    seeds = spark.createDataFrame([("https://h.com/",), ("https://h.com/",)], "url string")
    got = {r.url: (r.depth, r.status) for r in crawl.crawl(seeds, fetch, max_depth=2, admit=admit, save=save).collect()}
    assert got == {"https://h.com/": (0, 200), "https://h.com/a": (1, 200), "https://h.com/b": (2, 200)} and sorted(saved) == sorted(got)
    assert crawl.crawl(seeds, fetch, max_depth=9, max_pages=2, admit=admit).count() == 2
    with pytest.raises(OSError):
        crawl.crawl(seeds, fetch, admit=admit, save=lambda df: (_ for _ in ()).throw(OSError("always")))


def test_retry_accounts_and_progress_of_streams(spark, tmp_path):
    spark.createDataFrame([("a", 503), ("b", 404), ("c", 200)], "url string, status int").coalesce(1).write.parquet(str(tmp_path / "r"))
    live = spark.readStream.schema("url string, status int").parquet(str(tmp_path / "r"))
    got = {r.url: (r.attempts, r.state) for r in ingest.drained(ingest.retry_accounts(live), "accounts", "update").collect()}
    assert got == {"a": (1, "waiting"), "b": (1, "given up"), "c": (1, "done")}
    spark.createDataFrame([("2024-01-01 00:00:00", 200), ("2024-01-01 00:00:10", 500)], "ts string, status int").select(F.col("ts").cast("timestamp").alias("ts"), "status").write.parquet(str(tmp_path / "p"))
    live = spark.readStream.schema("ts timestamp, status int").parquet(str(tmp_path / "p"))
    r = ingest.drained(ingest.live_progress(live, 10), "progress", "complete").first()
    assert (r.pages, r.succeeded, r.failed, r.rate, r.percent, r.eta) == (2, 1, 1, 0.2, 20.0, 40.0)
    spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 00:00:05")], "t string, ts string").select("t", F.col("ts").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "f"))
    assert ingest.drained(ingest.first_seen(spark.readStream.schema("t string, ts timestamp").parquet(str(tmp_path / "f")), "t"), "first").count() == 1


def test_hosts_and_policies(spark):
    assert one(spark, U.any_host(F.lit("Bücher.example."))) == "xn--bcher-kva.example" and one(spark, U.any_host(F.lit("a_b.com"))) is None
    assert one(spark, U.origin(F.lit("HTTPS://H.com:8443/x"))) == "https://h.com:8443" and one(spark, U.robots_url(F.lit("http://h.com:80/x"))) == "http://h.com/robots.txt"
    assert [one(spark, crawl.robots_available(F.lit(s))) for s in (None, 403, 500, 200, 404)] == ["deny", "deny", "deny", "read", "allow"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([page(1, "alpha"), page(2, "beta")], "page_id long, url string, html string").write.parquet(str(src))
    s = Store(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema("page_id long, url string, html string").parquet(str(src))
    for _ in range(2):
        ingest.index_stream(stream, s, str(tmp_path / "cp")).awaitTermination()
    assert s.info().first().documents == 2 and s.history().count() == 1
    req = [("h", i, float(a)) for i, a in enumerate((0, 0.2, 5, 5.1))] + [("g", 9, 1.0)]
    spark.createDataFrame(req, "host string, id long, arrival double").write.parquet(str(tmp_path / "req"))
    live = spark.readStream.schema("host string, id long, arrival double").parquet(str(tmp_path / "req"))
    got = {r.id: r.start for r in ingest.drained(ingest.paced(live, 1.0), "paced").collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 5.0, 3: 6.0, 9: 1.0}


def test_record_sinks(spark, tmp_path):
    rows = [("u", 'ti"t,le', "te\nxt é", ["l"], {"b": "1", "a": "2"}, None, 200, "h"), ("u2", "t", "x", [], {}, None, 99, "h")]
    df = spark.createDataFrame(rows, records.SCHEMA).withColumn("crawled_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    good, bad = records.checked(df)
    assert [r.problem for r in bad.collect()] == ["status out of range"]
    path = str(tmp_path / "a")
    assert [records.archive(good.union(good), path), records.archive(good, path)] == [1, 0]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # what can't be read isn't taken for an empty archive
        records.archive(good, str(tmp_path / "broken"))
    assert records.write_json_array(good, str(tmp_path / "a.json")) == 1 and json.loads((tmp_path / "a.json").read_text())[0]["url"] == "u"
    records.write_csv(good, str(tmp_path / "c"))
    records.write_jsonl(good, str(tmp_path / "j"))
    assert records.read_csv(spark, str(tmp_path / "c")).collect() == good.select(*records.FIELDS).collect() == spark.read.schema(records.SCHEMA).json(str(tmp_path / "j")).collect()


# crawl


def test_robots(spark):
    groups = crawl.parse_robots("User-agent: *\nDisallow: /p\nAllow: /p\nDisallow: /*.gif$\n\nUser-agent: Bot\nUser-agent: b2 # x\nCrawl-delay: 2\nDisallow: /%7Ejoe")
    assert [g["user_agents"] for g in groups] == [["*"], ["bot", "b2"]] and groups[1]["crawl_delay"] == 2
    u = spark.createDataFrame([(p, "o", p) for p in ("/p", "/a.gif", "/a.gif?", "/~joe/x", "/q")], "url string, origin string, path string")
    r = spark.createDataFrame([("o", groups)], "origin string, groups array<struct<user_agents:array<string>,allow:array<string>,disallow:array<string>,crawl_delay:double>>")
    by = lambda a: {x.url: x.allowed for x in crawl.robots_decisions(u, r, a).collect()}
    assert by("zzz") == {"/p": True, "/a.gif": False, "/a.gif?": True, "/~joe/x": True, "/q": True}
    assert by("MyBot/2") == {"/p": True, "/a.gif": True, "/a.gif?": True, "/~joe/x": False, "/q": True}


def test_policy_and_hosts(spark):
    urls = ["http://a.com/", "http://[::1]/", "http://169.254.1.1/", "http://a.com:0/", "http://a.com\\@b/", "http://x.allowed.org/", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.refused for r in crawl.policy(df).collect()] == [None, "address", "address", "port", "malformed", None, "malformed"]
    assert [r.refused for r in crawl.policy(df.limit(1).union(df.where("url like '%allowed%'")), allow_hosts=["allowed.org"]).collect()] == ["not listed", None]
    assert one(spark, U.canonical_host(F.lit("Exa-mple.COM."))) == "exa-mple.com" and one(spark, U.canonical_host(F.lit("-bad.com"))) is None


def test_sitemaps(spark):
    assert sitemap.parse('<!DOCTYPE x><urlset/>')["problem"] == "document type" and sitemap.parse("<urlset><url/></urlset>")["problem"] == "entry without location" and sitemap.parse("<a>")["problem"] == "not well formed"
    docs = [("r", "<sitemapindex><sitemap><loc>r</loc></sitemap><sitemap><loc>s</loc></sitemap></sitemapindex>"), ("s", "<urlset><url><loc>u1</loc></url><url><loc>u1</loc></url><url><loc>u2</loc></url></urlset>")]
    df = spark.createDataFrame(docs, "url string, xml string")
    assert sorted(r.url for r in sitemap.expand(df.select("url").limit(1), df).collect()) == ["u1", "u2"]


def test_fetch_follows_redirects_under_policy():
    class Answer:
        def __init__(self, status, headers, body=b""):
            self.status, self.body = status, body
            self.headers = __import__("email").message_from_string("".join(f"{k}: {v}\n" for k, v in headers.items()))

        def read(self, n):
            return self.body[:n]

    class Opener:
        def open(self, request, timeout):
            return {"http://a/": Answer(302, {"Location": "/b"}), "http://a/b": Answer(200, {"Content-Type": "text/html; charset=latin-1"}, "é".encode("latin-1"))}[request.full_url]

    row = http.fetch("http://a/", may=lambda u: True, opener=Opener())
    assert (row["final_url"], row["html"], row["status_code"]) == ("http://a/b", "é", 200)
    assert http.fetch("http://127.0.0.1/")["error"] == "refused by policy"
    assert http.fetch("http://a/", may=lambda u: True, opener=Opener(), cap=0)["error"] == "too large"


def test_dataset_subset_and_fingerprint(spark):
    q = spark.createDataFrame([("q1", "x", "a"), ("q2", "y", "b")], "query_id string, query string, category string")
    assert datasets.subset(q, ["a"]).count() == 1
    for bad in ({"ids": ["q9"]}, {"categories": ["z"]}):
        with pytest.raises(ValueError):
            datasets.subset(q, **bad)
    assert datasets.fingerprint({"b": 1, "a": 2}) == datasets.fingerprint({"a": 2, "b": 1})


def test_sitemap_urls_keeps_all_of_a_large_page_table(spark, tmp_path):
    spark.range(50_010).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.com/"), "id").alias("url"), F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    assert crawling.sitemap_urls(spark, str(tmp_path)).count() == 50_010
