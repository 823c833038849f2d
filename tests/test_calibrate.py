"""Platt scaling against a plain Newton fit, and SVM probabilities that use it."""

import math
import random

import numpy as np

from gazette.operators import calibrate as P
from gazette.operators import ml


def plain_fit(m, y):
    """The same two numbers by full Newton steps in numpy."""
    m, y = np.array(m), np.array(y, bool)
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    x = np.stack([m, np.ones_like(m)], axis=1)
    w = np.array([0.0, math.log(((~y).sum() + 1) / (y.sum() + 1))])
    f = lambda v: np.sum(t * (x @ v) + np.log1p(np.exp(-(x @ v))))
    for _ in range(200):
        p = 1 / (1 + np.exp(x @ w))
        g = x.T @ (t - p)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-12 * np.eye(2)
        d, k = -np.linalg.solve(h, g), 1.0
        while k > 1e-9 and f(w + k * d) > f(w):
            k /= 2
        w = w + k * d
    return w


def test_two_numbers_per_class(spark):
    r = random.Random(3)
    rows = []
    for cls, (slope, shift, n) in {0: (2.0, 0.3, 400), 1: (0.2, -1.0, 150), 2: (8.0, 0.0, 90), 3: (1.0, 0.0, 1)}.items():
        for _ in range(n):
            m = r.gauss(0, 1.5)
            rows.append((cls, r.random() < 1 / (1 + math.exp(-slope * m - shift)), m))
    rows += [(4, m > 0, m) for m in (-2.0, -1.5, 1.0, 3.0)] + [(5, False, float(i)) for i in range(5)]      # separable; one-sided
    got = P.fit_sigmoid(spark.createDataFrame(rows, "cls int, y boolean, m double"))
    assert set(got) == {0, 1, 2, 3, 4, 5}
    for c in (0, 1, 2, 4):
        want = plain_fit([m for k, _, m in rows if k == c], [y for k, y, _ in rows if k == c])
        assert np.allclose(got[c], want, atol=1e-3), (c, got[c], want)
    assert got[0][0] < -1 and P.fit_sigmoid(spark.createDataFrame([], "cls int, y boolean, m double")) == {}


def test_folds_hold_every_label(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(60)], "id int, y int")
    out = P.folds(df, "y", "id")
    assert {r["_fold"] for r in out.collect()} == set(range(P.FOLDS))
    assert P.folds(spark.createDataFrame([(1, 0), (2, 1)], "id int, y int"), "y", "id") is None


def test_svm_probabilities_are_calibrated(spark):
    """Noisy labels: a model that claims certainty would be wrong; Platt scaling gives the rate at which it is right."""
    r = random.Random(5)
    words = {"biz": "market bank profit shares trade".split(), "sport": "match team goal player final".split()}

    def row(i):
        label = r.choice(["biz", "sport"])
        shown = label if r.random() < 0.8 else ("sport" if label == "biz" else "biz")
        return (i, " ".join(r.choices(words[shown], k=4) + r.choices("one two three four five six".split(), k=6)), label)
    train = spark.createDataFrame([row(i) for i in range(240)], "article_id long, text string, label string")
    test = [row(1000 + i) for i in range(150)]
    out = {x.article_id: x for x in ml.classify_svm(spark.createDataFrame(test, train.schema), train).collect()}
    right = sum(out[i].category == y for i, _, y in test) / len(test)
    claimed = sum(x.confidence for x in out.values()) / len(out)
    assert abs(right - claimed) < 0.12 and 0.6 < claimed < 0.95
