"""Column-level text functions (JVM-side).

Substring counts stay inside whole-stage code generation; ``words`` uses a
higher-order function, which Spark evaluates without generated code.

Python string semantics are reproduced with Unicode-aware Java regexes:
``str.strip()`` -> ``trim_ws``, ``len(str.split())`` -> ``word_count``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's white space: every character for which str.isspace() is true (all
# of them lie below U+3001). Derived by rule, so strip() and split() match
# Python exactly (a regex \s would miss U+001C..U+001F).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
WHITESPACE_RUN = "[" + "".join("\\u%04x" % ord(ch) for ch in PY_WHITESPACE) + "]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Strip leading and trailing white space of any kind (like ``str.strip``)."""
    return F.trim(col_(c), F.lit(PY_WHITESPACE))


def words(c) -> Column:
    """``str.split()``: white-space separated words, no empty strings."""
    return F.filter(F.split(col_(c), WHITESPACE_RUN), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c)).cast("long")


def compose_text(title="title", description="description", prefix: str | None = None) -> Column:
    """``f"{title}. {description}"`` with a missing description as ``''``."""
    parts = [col_(title), F.lit(". "), F.coalesce(col_(description), F.lit(""))]
    if prefix:
        parts.insert(0, F.lit(prefix))
    return F.concat(*parts)


def sql_str(v: str) -> str:
    """A Spark SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(x: float) -> str:
    return repr(float(x)) + "D"


def str_array(values: Sequence[str]) -> Column:
    """Array literal built from one SQL expression (one call, however long the list)."""
    if not values:
        return F.array().cast("array<string>")
    return F.expr("array(" + ", ".join(sql_str(v) for v in values) + ")")


def keyword_hits(text, keywords: Sequence[str], lowered: bool = False) -> Column:
    """Number of dictionary entries contained (as substrings) in lower(text).

    A sum of ``contains`` over literals: no join, no shuffle, and part of the
    scan's generated code. A null text has no hits.
    """
    t = col_(text) if lowered else F.lower(col_(text))
    hits = [F.coalesce(F.contains(t, F.lit(k)).cast("long"), F.lit(0)) for k in keywords]
    return sum(hits[1:], hits[0]).cast("long") if hits else F.lit(0).cast("long")


def py_len_sum(*cols) -> Column:
    """Sum of code-point lengths, treating null as ''."""
    out = None
    for c in cols:
        term = F.coalesce(F.length(col_(c)), F.lit(0))
        out = term if out is None else out + term
    return out.cast("long")
