"""Vector column functions on ``array<double>`` (higher-order functions: JVM-side, without generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import col_


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col_(a), F.lit(0.0), lambda acc, x: acc + x * x))


def to_double(a) -> Column:
    return col_(a).cast("array<double>")


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
