"""Collection: per-source cap, filters, title de-duplication, global cap.

Order is part of the semantics: sources in order, then entries in feed order.
Every article carries ``source_ord`` (order of its source; without that column
the source's name) and ``pos`` (entry order inside the source); ties are
always broken by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette import dims
from gazette.functions.text import compose_text as _compose, py_len_sum, trim_ws



def with_source_order(df: DataFrame, sources=dims.FEED_SOURCES) -> DataFrame:
    """Adds ``source_ord``: the place of ``source`` in the feed list; unlisted sources come last."""
    m = F.create_map(*[x for i, (name, _) in enumerate(sources) for x in (F.lit(name), F.lit(i))])
    return df.withColumn("source_ord", F.coalesce(F.try_element_at(m, F.col("source")), F.lit(len(sources))))


def collection_order(df: DataFrame) -> tuple[str, ...]:
    return ("source_ord", "source", "pos") if "source_ord" in df.columns else ("source", "pos")


def trim_text(df: DataFrame) -> DataFrame:
    """Strip title and description; a missing value becomes ''."""
    return (df.withColumn("title", trim_ws(F.coalesce("title", F.lit(""))))
              .withColumn("description", trim_ws(F.coalesce("description", F.lit("")))))


def cap_per_source(df: DataFrame, n: int = 30, source_col: str = "source", order_col: str = "pos") -> DataFrame:
    """First ``n`` entries of every source, before any filter.

    ``row_number() <= n`` is planned as a WindowGroupLimit: each map task keeps
    only its top n per source before the shuffle, so a huge source costs n rows
    of shuffle per task, not all of its rows.
    """
    w = Window.partitionBy(source_col).orderBy(order_col)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def require_title(df: DataFrame) -> DataFrame:
    """Drop rows without a title."""
    return df.filter(F.col("title").isNotNull() & (F.col("title") != ""))


def filter_language(df: DataFrame, lang: str = "en", lang_col: str = "language") -> DataFrame:
    """Keep one language; rows whose language is unknown are dropped."""
    return df.filter(F.col(lang_col) == lang)


def filter_length(df: DataFrame, max_chars: int = 800) -> DataFrame:
    """Keep ``len(title + description) <= max_chars`` code points."""
    return df.filter(py_len_sum("title", "description") <= max_chars)


def dedup_title(df: DataFrame, order=None) -> DataFrame:
    """One row per title, the first in collection order wins.

    A grouped ``min_by`` instead of a window: it aggregates partially before the
    shuffle, so one title repeated across a third of the input is combined
    map-side instead of landing whole in one task.
    """
    cols = df.columns
    key = F.struct(*[F.col(c) for c in order or collection_order(df)])
    return (df.groupBy("title").agg(F.min_by(F.struct(*[F.col(c) for c in cols]), key).alias("_r"))
              .select("_r.*"))


def cap_total(df: DataFrame, n: int | None, order=None) -> DataFrame:
    """First ``n`` accepted articles in collection order (TakeOrderedAndProject)."""
    ordered = df.orderBy(*(order or collection_order(df)))
    return ordered.limit(n) if n is not None else ordered


def collect_pipeline(df: DataFrame, max_total: int | None = 100, per_source: int = 30, lang: str | None = "en",
                     max_chars: int = 800) -> DataFrame:
    """P1..P8 in the order of the reference collector."""
    out = cap_per_source(trim_text(df), per_source)
    out = require_title(out)
    if lang is not None:
        out = filter_language(out, lang)
    out = dedup_title(filter_length(out, max_chars))
    return cap_total(out, max_total)


def collect_report(df: DataFrame) -> DataFrame:
    """Number of accepted articles and of contributing sources."""
    return df.agg(F.count("*").alias("articles"), F.countDistinct("source").alias("sources"))


def compose_text(df: DataFrame, prefix: str | None = None, out: str = "text") -> DataFrame:
    """P10: the classified text ``title. description`` with an optional model prefix."""
    return df.withColumn(out, _compose(prefix=prefix))
