"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its character n-grams (2 to 4) in 2**BITS buckets; their embeddings are averaged and a softmax layer
gives the languages' probabilities. Training uses at most ``sample`` labelled rows, drawn by the hash of their id: a documented bound,
the only one. A tenth of them is held back to fit the temperature of the softmax and the rejection threshold: the
half of the probability under which ``reject`` of the rightly labelled held-back rows fall.

Prediction reads whole texts. As the softmax layer is linear, the embedding table times the layer is one small table of 2**BITS rows
and a column for each language, which the tasks get.

Defined results. A null text, or one without a letter, is ``und`` with score 0. If no row is labelled, every text is ``und``.
All labels of the drawn rows are learned, however many. Equal probabilities go to the first label by name. An empty table
gives no rows. Each input row gives one row; repeated rows give equal ones. A null id is never held out.
Only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.llm.ngrams import codes, pieces
from webskein.llm.text import filtered

BITS = 16
DIM = 24
ORDERS = (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: str, parts: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == rest, F.lit(False))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = np.zeros(1 << BITS, np.float32)
    for p in pieces(codes(text), ORDERS, BITS):
        n += np.bincount(p, minlength=1 << BITS)
    i = np.flatnonzero(n)
    return i, n[i] / n[i].sum()


class Model:
    """labels, table (2**BITS rows of logits' shares), bias, temperature, threshold."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.labels, self.table, self.bias, self.temperature, self.threshold = labels, table, bias, temperature, threshold

    def logits(self, text: str) -> np.ndarray:
        """In pieces over the whole text."""
        total, n = np.zeros(len(self.labels)), 0
        for p in pieces(codes(text), ORDERS, BITS):
            p = p.astype(np.intp)  # once, not for each label
            for k in range(len(self.labels)):
                total[k] += self.table[k].take(p).sum(dtype=np.float64)
            n += len(p)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or text is None or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(min(max(p[k], 0.0), 1.0))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 12, steps: int = 1500, batch: int = 16, rate: float = 2.0, reject: float = 0.001) -> Model:
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(x) for x in langs])
    x = [counts(t) for t in texts]
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    w, bias = np.zeros((len(labels), DIM), np.float32), np.zeros(len(labels), np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    order = rng.permutation(len(x))
    back = order[: len(x) // 10]
    train = order[len(x) // 10 :]
    epochs = max(epochs, min(200, -(-steps * batch // max(1, len(train)))))  # few rows are gone over more often
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for at in range(0, len(train), batch):
            ids = train[at : at + batch]
            hidden = np.stack([x[i][1] @ emb[x[i][0]] for i in ids])
            g = softmax(hidden @ w.T + bias)
            g[np.arange(len(ids)), y[ids]] -= 1
            g /= len(ids)
            back_h = g @ w
            w -= lr * g.T @ hidden
            bias -= lr * g.sum(0)
            for j, i in enumerate(ids):
                emb[x[i][0]] -= (lr * 20) * np.outer(x[i][1], back_h[j])
        train = rng.permutation(train)
    table = np.ascontiguousarray((emb @ w.T).T)
    model = Model(labels, table, bias.astype(np.float64), 1.0, 0.0)
    if len(back):
        logits = np.stack([x[i][1] @ table.T[x[i][0]] + bias for i in back])
        heat = 2.0 ** np.arange(-4, 6.01, 0.25)
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(back)), y[back]], 1e-12)).mean() for t in heat]
        model.temperature = float(heat[int(np.argmin(loss))])
        p = softmax(logits / model.temperature)
        right = p.argmax(1) == y[back]
        if right.any():
            model.threshold = float(np.quantile(p.max(1)[right], reject, method="lower")) * 0.5
    return model


def drawn(rows: DataFrame, key: Column, n: int, sample: int, salt: str) -> DataFrame:
    """About ``sample`` of ``n`` rows, by the hash of their key: the same ones in any order and partitioning."""
    share = min(1.0, 0.95 * sample / max(n, 1))
    return rows if share == 1.0 else rows.where(F.xxhash64(key.cast("string"), F.lit(salt)) < F.lit(int(-(2**63) + share * 2.0**64)))


def train(docs: DataFrame, labelled: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000) -> Model:
    """Fit on at most ``sample`` rows of those that ``labelled`` admits; the driver holds these rows alone."""
    rows = docs.where(labelled & F.col(lang).isNotNull())
    taken = drawn(rows.where(F.col(text).isNotNull()), F.col(doc_id), rows.count(), sample, "langid").select(F.col(lang).alias("lang"), F.col(text).alias("text")).collect()
    taken = sorted((r.text, r.lang) for r in taken if LETTER.search(r.text))[:sample]
    return fit([t for t, _ in taken], [x for _, x in taken])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, keep's columns, lang_pred, score, rejected (und, or a score under the threshold)."""
    keep = keep or {}
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *(c.alias(n) for n, c in keep.items()), F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == "und" or g[1] < m.threshold for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["lang_pred string", "score double", "rejected boolean"])
    return rows.mapInArrow(run, schema)


def known_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(texts: list) -> list[bool]:
        m = shared.value
        return [g[0] != "und" and g[1] >= m.threshold for g in map(m.predict, texts)]

    return filtered(docs, text, known)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out("doc_id", 3, 1)
    model = train(docs, ~out)
    return identify(docs, model, keep={"held_out": out}).select("doc_id", "held_out", "lang_pred", "score", "rejected")
