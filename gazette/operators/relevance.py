"""Relevance gate (R1-R5): dictionary hits, word count, rule ladder, split, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette import dims
from gazette.functions.text import compose_text, keyword_hits as _hits, word_count
from gazette.operators.dictionary import SHORT, dictionary_hits, hits_of


def _text(text_col):
    return compose_text() if text_col is None else F.col(text_col)


def keyword_hits(df: DataFrame, irrelevant: Sequence[str] = dims.IRRELEVANT_KEYWORDS,
                 relevant: Sequence[str] = dims.RELEVANT_KEYWORDS, text_col: str | None = None) -> DataFrame:
    """Distinct dictionary entries contained in the lower-cased text.

    Short lists are literals in the projection; longer ones are matched in one pass by ``dictionary_hits``.
    """
    lt = F.lower(_text(text_col))
    if len(irrelevant) + len(relevant) > SHORT:
        return (dictionary_hits(df, [irrelevant, relevant], lt, "_hits")
                .withColumn("irrelevant_hits", hits_of(0, "_hits")).withColumn("relevant_hits", hits_of(1, "_hits")).drop("_hits"))
    return (df.withColumn("_lt", lt)
              .withColumn("irrelevant_hits", _hits("_lt", irrelevant, lowered=True))
              .withColumn("relevant_hits", _hits("_lt", relevant, lowered=True))
              .drop("_lt"))


def check_relevance(df: DataFrame, irrelevant: Sequence[str] = dims.IRRELEVANT_KEYWORDS,
                    relevant: Sequence[str] = dims.RELEVANT_KEYWORDS, text_col: str | None = None,
                    keep_scores: bool = False) -> DataFrame:
    """R2+R3: rule ladder, first match wins; adds ``is_relevant, relevance_confidence``."""
    out = keyword_hits(df, irrelevant, relevant, text_col).withColumn("_words", word_count(_text(text_col)))
    irr, rel, wc = F.col("irrelevant_hits"), F.col("relevant_hits"), F.col("_words")
    rule = (F.when(irr > 2, F.struct(F.lit(False), F.lit(0.1)))
             .when((rel == 0) & (wc < 10), F.struct(F.lit(False), F.lit(0.3)))
             .when(wc < 5, F.struct(F.lit(False), F.lit(0.2)))
             .when(wc > 500, F.struct(F.lit(False), F.lit(0.2)))
             .when(rel > 0, F.struct(F.lit(True), F.least(F.lit(0.9), F.lit(0.5) + rel * F.lit(0.1))))
             .otherwise(F.struct(F.lit(True), F.lit(0.7))))
    out = (out.withColumn("_rule", rule)
              .withColumn("is_relevant", F.col("_rule.col1"))
              .withColumn("relevance_confidence", F.col("_rule.col2").cast("double"))
              .drop("_rule"))
    if keep_scores:
        return out.withColumnRenamed("_words", "word_count")
    return out.drop("_words", "irrelevant_hits", "relevant_hits")


def split_relevance(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relevant, irrelevant); a missing flag counts as relevant."""
    flag = F.coalesce(F.col("is_relevant"), F.lit(True))
    return df.filter(flag), df.filter(~flag)


def relevance_report(df: DataFrame) -> DataFrame:
    """Relevant count, total, percent with one decimal."""
    flag = F.coalesce(F.col("is_relevant"), F.lit(True))
    return (df.agg(F.count_if(flag).alias("relevant"), F.count("*").alias("total"))
              .withColumn("percent", F.round(F.col("relevant") * 100.0 / F.col("total"), 1)))
