"""Quality by ordinal cumulative-link regression over hashed text features.

Grades: 0 toxic, 1 poor, 2 good, from the ratings ``toxic`` and ``quality``. All grades share one weight vector over 2**BITS hashed
features, the latent score f; ordered thresholds give P(grade <= k) = sigmoid(t_k - f). Features are the distinct words of the
whole text (punctuation taken off) and the text's shape in bins: length, share of distinct words, of signs, of capitals, of words that repeat
the one before.

Training uses at most ``sample`` rated rows, drawn by the hash of their id: a documented bound, the only one. A fifth is held back;
the cut on the tail probability P(grade >= 2) is the value that ``lose`` of the held-back good rows fall under, but at most one half.

Defined results. A null or wordless text has grade and tail 0 and isn't kept. Rows with a null rating train nothing; of several ratings of an id the
lowest grade counts. Without any rating, every text with a word is kept with the grade 2. Each input row gives one row, repeated and null ids included; an empty table gives no rows. Very long texts are
read whole, one at a time. Only the named columns are read; others may have any names.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.llm.langid import drawn
from webskein.llm.text import hashes

BITS = 18
SIGNS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
PLAIN = bytes.maketrans(SIGNS, b" " * len(SIGNS))
CAPITALS = bytes(range(65, 91))


def features(text: bytes | None) -> np.ndarray | None:
    """Bucket numbers of a whole text, each once; None without a word."""
    if not text or not (raw := text.split()):
        return None
    bare = text.lower().translate(PLAIN).split()
    signs, capitals = len(text) - len(text.translate(None, SIGNS)), len(text) - len(text.translate(None, CAPITALS))
    shape = [
        b"\0length %d" % min(12, len(raw).bit_length()),
        b"\0distinct %d %d" % (min(6, len(raw).bit_length() // 2), 10 * len(set(raw)) // len(raw)),
        b"\0signs %d" % min(20, 40 * signs // len(text)),
        b"\0capitals %d" % (10 * capitals // len(text)),
        b"\0repeats %d" % (20 * sum(map(eq, raw, raw[1:])) // len(raw)),
    ]
    return np.unique(hashes([*set(bare), *shape]) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, cut: float):
        self.weights, self.thresholds, self.cut = weights, thresholds, cut

    def judge(self, text: bytes | None) -> tuple[float, float]:
        """Expected grade and P(grade >= 2)."""
        x = features(text)
        if x is None:
            return 0.0, 0.0
        tails = 1 - sigmoid(self.thresholds - float(self.weights[x].sum(dtype=np.float64)))
        return float(tails.sum()), float(tails[-1])


def fit(texts: list[bytes], grades: list[int], seed: int = 11, steps: int = 400, rate: float = 0.3, sparse: float = 0.002, seen: int = 4, lose: float = 0.002) -> Model:
    rows = [(x, g) for x, g in zip(map(features, texts), grades) if x is not None]
    weights = np.zeros(1 << BITS)
    if not rows:
        return Model(weights.astype(np.float32), np.array([-60.0, -60.0]), 0.0)
    order = np.random.default_rng(seed).permutation(len(rows))
    back, train = [rows[i] for i in order[: len(rows) // 5]], [rows[i] for i in order[len(rows) // 5 :]]
    y = np.array([g for _, g in train])
    feat = np.concatenate([x for x, _ in train])
    doc = np.repeat(np.arange(len(train)), [len(x) for x, _ in train])
    common = np.bincount(feat, minlength=1 << BITS) >= min(seen, len(train))  # a bucket of fewer rows keeps the weight 0
    feat, doc = feat[common[feat]], doc[common[feat]]
    share = np.clip(np.array([(y <= 0).mean(), (y <= 1).mean()]), 0.01, 0.99)
    share[1] = max(share[1], share[0] + 1e-3)
    theta = np.log(share / (1 - share))
    power, power_t = np.full(1 << BITS, 1e-8), np.full(2, 1e-8)
    n = len(train)
    for _ in range(steps):
        f = np.bincount(doc, weights=weights[feat], minlength=n)
        # P(y) is the difference of the two sigmoids around f
        hi = np.where(y == 2, 1.0, sigmoid(np.where(y == 0, theta[0], theta[1]) - f))
        lo = np.where(y == 0, 0.0, sigmoid(np.where(y == 2, theta[1], theta[0]) - f))
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        g = (dhi - dlo) / p / n  # d(-log p)/df
        gt = np.array([-(np.where(y == 0, dhi, 0) - np.where(y == 1, dlo, 0)) / p, -(np.where(y == 1, dhi, 0) - np.where(y == 2, dlo, 0)) / p]).sum(1) / n
        gw = np.bincount(feat, weights=g[doc], minlength=1 << BITS)
        power += gw * gw
        power_t += gt * gt
        pace = rate / np.sqrt(power)
        weights -= pace * gw
        weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * sparse, 0)  # words without a steady say keep the weight 0
        theta -= rate * gt / np.sqrt(power_t)
        theta[1] = max(theta[1], theta[0] + 1e-3)
    model = Model(weights.astype(np.float32), theta, 0.5)
    good = [1 - sigmoid(theta[1] - weights[x].sum()) for x, g in back if g == 2]
    if good:
        model.cut = float(min(0.5, np.quantile(good, lose, method="lower")))
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 6000) -> Model:
    """Fit on at most ``sample`` rated rows; their ids, and so the broadcast, have the same bound."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    few = drawn(rated, F.col("doc_id"), rated.count(), sample, "quality").select(F.col("doc_id").alias("rated_id"), "grade")
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    taken = sorted((bytes(r.t), r.grade) for r in own.where("t is not null").join(F.broadcast(few), F.col("id") == F.col("rated_id")).select("t", "grade").collect())[:sample]
    return fit([t for t, _ in taken], [g for _, g in taken])


def grade(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_prob, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[1] >= m.cut and g[1] > 0 for g in got], pa.bool_())], names=["doc_id", "expected_grade", "tail_prob", "kept"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, expected_grade double, tail_prob double, kept boolean")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
