"""Probabilities from margins (C11): Platt scaling as aggregations.

A class's margin ``m`` becomes ``1 / (1 + exp(a * m + b))``; ``a`` and ``b`` minimise
the cross-entropy against smoothed targets (Platt 1999, with the safeguarded
Newton steps of Lin, Lin and Weng 2007). All classes are fitted together: a
Newton step is one aggregation over the margins for gradient and curvature and
one that tries all step lengths; the driver sees a few sums per class.

The margins must come from models that did not see the rows (``folds``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 3
STEPS = 100
HALVINGS = 20
GRADIENT = 1e-5


def folds(train: DataFrame, label_col: str, *keys: str, n: int = FOLDS) -> DataFrame | None:
    """``train`` with ``_fold``, by a hash of the keys; None if some label would be missing in a training part."""
    out = train.withColumn("_fold", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    spread = out.groupBy(label_col).agg(F.countDistinct("_fold").alias("k"))
    return out if spread.filter(F.col("k") < 2).limit(1).count() == 0 else None


def _of(params: dict, cls: Column, i: int) -> Column:
    return F.element_at(F.create_map(*[x for c, p in params.items() for x in (F.lit(c), F.lit(float(p[i])))]), cls)


def fit_sigmoid(margins: DataFrame, class_col: str = "cls", y_col: str = "y", m_col: str = "m") -> dict:
    """``class -> (a, b)`` of rows (class, does the row belong to it, margin); read a few times, so pass a stored frame."""
    sizes = margins.groupBy(class_col).agg(F.count_if(y_col).alias("pos"), F.count_if(~F.col(y_col)).alias("neg")).collect()
    targets = {r[class_col]: ((r["pos"] + 1.0) / (r["pos"] + 2.0), 1.0 / (r["neg"] + 2.0)) for r in sizes}
    params = {r[class_col]: (0.0, math.log((r["neg"] + 1.0) / (r["pos"] + 1.0))) for r in sizes}
    if not params:
        return {}
    cls, m = F.col(class_col), F.col(m_col)
    t = F.when(F.col(y_col), _of(targets, cls, 0)).otherwise(_of(targets, cls, 1))

    def loss(z: Column) -> Column:
        return F.when(z >= 0, t * z + F.log1p(F.exp(-z))).otherwise((t - 1.0) * z + F.log1p(F.exp(z)))

    open_ = set(params)
    for _ in range(STEPS):
        z = _of(params, cls, 0) * m + _of(params, cls, 1)
        p = F.when(z >= 0, F.exp(-z) / (1.0 + F.exp(-z))).otherwise(1.0 / (1.0 + F.exp(z)))
        rows = margins.filter(cls.isin(sorted(open_))).select(class_col, m.alias("m"), (t - p).alias("d"), (p * (1.0 - p)).alias("w"), loss(z).alias("f"))
        sums = rows.groupBy(class_col).agg(
            F.sum("f").alias("f"), F.sum(F.col("m") * F.col("d")).alias("g1"), F.sum("d").alias("g2"),
            F.sum(F.col("m") * F.col("m") * F.col("w")).alias("h11"), F.sum(F.col("m") * F.col("w")).alias("h21"),
            F.sum("w").alias("h22")).collect()
        step = {}
        for r in sums:
            if abs(r["g1"]) < GRADIENT and abs(r["g2"]) < GRADIENT:
                open_.discard(r[class_col])
                continue
            h11, h22, h21 = r["h11"] + 1e-12, r["h22"] + 1e-12, r["h21"]
            det = h11 * h22 - h21 * h21
            da, db = -(h22 * r["g1"] - h21 * r["g2"]) / det, -(-h21 * r["g1"] + h11 * r["g2"]) / det
            step[r[class_col]] = (da, db, r["g1"] * da + r["g2"] * db, r["f"])
        if not step:
            break
        tried = [F.sum(loss((_of(params, cls, 0) + F.lit(0.5 ** k) * _of(step, cls, 0)) * m
                            + _of(params, cls, 1) + F.lit(0.5 ** k) * _of(step, cls, 1))).alias(f"f{k}") for k in range(HALVINGS)]
        for r in margins.filter(cls.isin(sorted(step))).groupBy(class_col).agg(*tried).collect():
            c = r[class_col]
            da, db, slope, f = step[c]
            k = next((k for k in range(HALVINGS) if r[f"f{k}"] < f + 1e-4 * 0.5 ** k * slope), None)
            if k is None:
                open_.discard(c)                               # no step makes it better: done within rounding
            else:
                params[c] = (params[c][0] + 0.5 ** k * da, params[c][1] + 0.5 ** k * db)
        if not open_:
            break
    return params


def sigmoid(margin: Column, a: float, b: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(a)) * margin + F.lit(float(b))))


def probabilities(margins: Column, params: dict, n_classes: int) -> Column:
    """Calibrated probabilities of an array of margins, one per class, normalised to one."""
    each = F.array(*[sigmoid(F.get(margins, F.lit(c)), *params[c]) if c in params else F.lit(0.0) for c in range(n_classes)])
    total = F.aggregate(each, F.lit(0.0), lambda x, y: x + y)
    return F.transform(each, lambda p: F.when(total > 0, p / total).otherwise(F.lit(1.0 / max(1, n_classes))))
