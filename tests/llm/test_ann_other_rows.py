"""op1's search on rows whose codes tell little: every truly nearest row is found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from webskein.llm import ann

RNG = np.random.default_rng(8)
N = 6000
CENTERS = RNG.normal(size=(12, 24))


def clusters():
    """500 members each, far more than the rows that are measured first, close together."""
    return CENTERS[np.arange(N) % 12] + 1e-6 * RNG.normal(size=(N, 24))


ROWS = {
    "clusters": clusters,
    "far mean": lambda: 1e5 + RNG.normal(size=(N, 24)),
    "unequal scales": lambda: RNG.normal(size=(N, 24)) * 10.0 ** RNG.integers(-4, 5, (N, 1)),
    "many dimensions": lambda: RNG.normal(size=(N, 200)),
    "large values": lambda: 1e60 * RNG.normal(size=(N, 24)),
    "few texts many times": lambda: RNG.normal(size=(40, 24))[np.arange(N) % 40],
}


@pytest.mark.parametrize("name", ROWS)
def test_all_of_the_nearest_are_found(spark, name):
    x = ROWS[name]()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, books=12, words=16, sample=1500, rerank=60, pack=2500)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())
    want = []
    for q in range(0, N, 100):
        d = np.zeros(N)
        for j in range(x.shape[1]):
            d += (x[:, j] - x[q, j]) ** 2
        d = np.sqrt(d)
        order = [i for i in np.lexsort((np.arange(N), d))[:11].tolist() if i != q]
        want += [(q, r + 1, i, float(d[i])) for r, i in enumerate(order[:10])]
    assert got == want
