"""The pipeline against a brute-force version of its stages, and its defined results."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_documents import LIBRARY, A, brute_components, brute_overlaps, plain_prediction, sentence, table  # noqa: E402
from webskein.llm import langid  # noqa: E402

TOKEN = re.compile(r"[A-Za-z0-9+_=-]{20,}")


def brute_mask(text, copied):
    spans = [(m.start(), m.end()) for m in A.finditer(text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = list(spans)
    for m in TOKEN.finditer(text):
        v = m[0]
        if len(re.findall("[0-9]", v)) >= 4 and len(re.findall("[A-Za-z]", v)) >= 4 and not any(a < m.end() and m.start() < b for a, b in base) and not copied(v):
            spans.append(m.span())
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def owners(docs):
    """Distinct sources by candidate value, by the plain way."""
    seen: dict[str, set] = {}
    for t, s in docs:
        values = [m[2] for m in A.finditer(t) if len(m[2]) >= 6] + [m[0] for m in re.finditer(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t)] + [m[0] for m in TOKEN.finditer(t)]
        for v in values:
            seen.setdefault(v, set()).add(s)
    return seen


def holds(text, item):
    """Whether a text holds an item, by all alignments; most pairs share too few words to be looked at."""
    bare = lambda t: Counter(re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).split())
    a, b = bare(text), bare(item)
    return (a & b).total() >= min(13, -(-4 * b.total() // 5)) and brute_overlaps(text, item) is not None


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = langid.train(docs, ~langid.held_out("doc_id", 3, 1))
    rows = []
    for r in docs.orderBy("doc_id").collect():
        lang, score = plain_prediction(model, r.text)
        if lang != "und" and score >= model.threshold:
            rows.append(r)
    comp, _ = brute_components([r.text for r in rows], 80)
    rows = [r for i, r in enumerate(rows) if comp[i] == i]
    rows = [r for r in rows if not any(holds(r.text, i) for i in items)]
    seen = owners([(r.text, r.source) for r in rows])
    want = {r.doc_id: LIBRARY.encode(brute_mask(r.text, lambda v: len(seen.get(v, ())) >= 3), add_special_tokens=False).ids for r in rows}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


INNER = ("near_id", "NEAR_k1", "near_k2", "secret_k1", "secret_k2", "secret_runs", "secret_text", "row_id", "__row", "__new", "__text", "__spans", "t", "k1", "value", "m", "node", "first", "start", "copied", "a.b")


def test_stages_keep_columns_of_any_name(spark, sf):
    texts = ["the cat and the dog are here today and the sun is up " + sentence(k) for k in range(3)]
    texts += [texts[0], texts[1] + " token = abcdefgh1"]
    docs = table(spark, texts, ids=[1, 2, 3, 1, 5]).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INNER})
    now = docs
    for _, f in corpus_pipeline.STAGES[1:-1]:
        now = f(spark, now, sf)
        assert now.columns == docs.columns
    rows = {r.doc_id: r for r in now.collect()}
    assert sorted(rows) == [1, 2, 3] and len(rows) == now.count()  # 5 is near 2, and the second row of 1 is a copy
    assert all(rows[i][c] == f"{c}{i}" for i in rows for c in INNER) and all(rows[i].text == texts[i - 1] for i in rows)
    masked = corpus_pipeline.secret_scan(spark, docs, sf).where("doc_id = 5").first()
    assert masked.text == texts[1] + " <secret>" and masked.n_chars == len(masked.text) and all(masked[c] == f"{c}5" for c in INNER)


def test_stages_keep_columns_and_handle_odd_rows(spark, sf):
    t = sentence(9)
    docs = table(spark, [None, "", t, t, t + " token = abcdefgh", "das und die der " * 3000, t], ids=[1, 2, 3, 4, 5, None, 3])
    for odd in (docs, docs.limit(0)):
        now = odd
        for _, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, sf)
            assert now.columns == odd.columns
            now.count()
        assert {"doc_id", "n_tokens", "ids"} <= set(corpus_pipeline.STAGES[-1][1](spark, now, sf).columns)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "secrets", "bpe"] and np.all([callable(f) for _, f in corpus_pipeline.STAGES])


def test_near_duplicates_of_the_stage_link_from_080(spark, sf):
    words = [f"w{i}" for i in range(305)]
    changed = lambda n: " ".join("z" if i % 50 == 20 and i // 50 < n else w for i, w in enumerate(words))
    texts = [" ".join(words), changed(6), " ".join(f"v{i}" for i in range(305)), " ".join(f"v{i}" if i < 265 else f"u{i}" for i in range(305))]
    # 271 of 331 shingles in common, 0.82; 261 of 341, 0.77
    assert brute_components(texts)[0] == [0, 1, 2, 3] and brute_components(texts, 80)[0] == [0, 0, 2, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, texts), sf).collect()) == [0, 2, 3]


def test_near_duplicates_of_the_stage_equal_brute_force(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").where("length(text) < 4000").orderBy("doc_id").limit(700)
    rows = docs.collect()
    want = brute_components([r.text for r in rows], 80)[0]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == [r.doc_id for i, r in enumerate(rows) if want[i] == i]
