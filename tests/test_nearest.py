"""Nearest prototype over blocks against one matrix product."""

import numpy as np
import pytest

from gazette.operators import classify as C
from gazette.operators import nearest as N


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


@pytest.mark.parametrize("block", [N.BLOCK_BYTES, 2_000, 100])
def test_blocks_change_nothing(spark, block):
    rng = np.random.default_rng(2)
    x, p = rng.normal(size=(200, 6)), rng.normal(size=(70, 6))
    p[40] = p[3] * 2                                             # a tie: the lower ord wins
    x[:5] = p[3]
    x[9] = 0
    df = spark.createDataFrame([(i, None if i == 7 else [float(v) for v in r], "old") for i, r in enumerate(x)],
                               "article_id long, vec array<double>, category string")
    protos = spark.createDataFrame([(i, f"p{i}", [float(v) for v in r]) for i, r in enumerate(p)], "ord int, category string, vec array<double>")
    got = {r.article_id: (r.category, r.confidence) for r in N.classify_nearest_table(df, protos, block_bytes=block).collect()}
    d = unit(x) @ unit(p).T
    for i in range(200):
        if i == 7:
            assert got[i] == ("unknown", 0.0)
        else:
            first = int((d[i] >= d[i].max() - 1e-9).argmax())
            assert got[i][0] == f"p{first}" and abs(got[i][1] - (d[i].max() if i != 9 else 0)) < 1e-9
    old = {r.article_id: r.category for r in C.classify_nearest(df, protos).collect()}
    assert {i: c for i, (c, _) in got.items()} == old


def test_a_hundred_thousand_prototypes(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(100_000, 8))
    df = spark.createDataFrame([(i, [float(v) for v in p[i * 700] + 1e-4]) for i in range(100)], "article_id long, vec array<double>")
    protos = spark.createDataFrame(__import__("pandas").DataFrame({"ord": np.arange(100_000), "category": [f"p{i}" for i in range(100_000)],
                                                                   "vec": list(p)}))
    out = N.classify_nearest_table(df, protos, block_bytes=1 << 20)
    assert {r.article_id: r.category for r in out.collect()} == {i: f"p{i * 700}" for i in range(100)}


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "article_id long, vec array<double>")
    none = spark.createDataFrame([], "ord int, category string, vec array<double>")
    assert [(r.category, r.confidence) for r in N.classify_nearest_table(df, none).collect()] == [("unknown", 0.0)]
    protos = spark.createDataFrame([(0, "a", [1.0, 0.0])], none.schema)
    assert N.classify_nearest_table(df.limit(0), protos).count() == 0
