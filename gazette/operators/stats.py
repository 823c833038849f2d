"""Store statistics and the comparison of classification methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# --------------------------------------------------------------------------- T1-T3
def store_totals(store: DataFrame, digests: DataFrame) -> DataFrame:
    """All articles, relevant (true), irrelevant (false; null counts in neither), digests."""
    arts = store.agg(F.count("*").alias("total_articles"),
                     F.count_if(F.col("is_relevant")).alias("relevant_articles"),
                     F.count_if(~F.col("is_relevant")).alias("irrelevant_articles"))
    n_digests = digests.select(F.count("*")).scalar()
    return arts.withColumn("total_digests", n_digests)


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Rows per value (null is a group), most first."""
    return df.groupBy(col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_first(col))


def stats_by_category(store: DataFrame) -> DataFrame:
    return count_by(store, "category")


def stats_by_source(store: DataFrame) -> DataFrame:
    return count_by(store, "source")


# --------------------------------------------------------------------------- T4
def run_stats(collected: DataFrame, classified: DataFrame, items: DataFrame) -> DataFrame:
    """Collected, classified, relevant, irrelevant articles and events of one run."""
    flag = F.coalesce(F.col("is_relevant"), F.lit(True))
    c = classified.agg(F.count("*").alias("articles_classified"), F.count_if(flag).alias("relevant_articles"),
                       F.count_if(~flag).alias("irrelevant_articles"))
    return c.select(collected.select(F.count("*")).scalar().alias("articles_collected"), "*",
                    items.select(F.count("*")).scalar().alias("events_created"))


# --------------------------------------------------------------------------- T5
def category_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """Category counts (missing -> ``unknown``), most first; optionally the top ``top``."""
    out = count_by(df.withColumn("category", F.coalesce("category", F.lit("unknown"))), "category")
    return out.limit(top) if top is not None else out


# --------------------------------------------------------------------------- T6
def _per_method(results: DataFrame) -> DataFrame:
    return results.groupBy("method").agg(F.count("*").alias("count"), F.avg("time").alias("avg_time"),
                                         F.countDistinct("category").alias("categories_used"),
                                         F.min("pos").alias("first"))


def _top_category(results: DataFrame) -> DataFrame:
    # most common category per method; ties go to the category seen first
    per = results.groupBy("method", "category").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return per.groupBy("method").agg(F.max_by("category", F.struct(F.col("n"), -F.col("first"))).alias("top_category"))


def method_comparison(results: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """Per method: rows, mean time, categories used, most common category.

    With a method list, methods without rows are reported with ``status = FAILED``.
    """
    out = _per_method(results).join(_top_category(results), "method").withColumn("status", F.lit("OK"))
    if methods:
        spark = results.sparkSession
        listed = spark.createDataFrame([(m, i) for i, m in enumerate(methods)], "method string, method_ord int")
        out = (listed.join(out, "method", "left")
               .withColumn("status", F.coalesce("status", F.lit("FAILED")))
               .withColumn("count", F.coalesce("count", F.lit(0))))
    return out


# --------------------------------------------------------------------------- T7, T8
def method_speed_rank(results: DataFrame, n: int = 5) -> DataFrame:
    """Fastest methods first (mean time > 0), top ``n`` with rank."""
    per = _per_method(results).filter(F.col("avg_time") > 0)
    order = [F.asc("avg_time"), F.asc("first")]
    top = per.orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "method", "avg_time")


def method_diversity_rank(results: DataFrame, n: int = 5) -> DataFrame:
    """Methods using the most categories, top ``n``; ties keep method order (first result)."""
    order = [F.desc("categories_used"), F.asc("first")]
    top = _per_method(results).orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "method",
                      "categories_used")


# --------------------------------------------------------------------------- T9
def method_distribution(results: DataFrame, n_methods: int = 3, top: int = 5) -> DataFrame:
    """For the first ``n_methods`` methods: top ``top`` categories with count and percent (1 decimal)."""
    first_methods = _per_method(results).orderBy("first").limit(n_methods).select("method", "count")
    per = (results.join(first_methods.select("method"), "method", "left_semi")
           .groupBy("method", "category").agg(F.count("*").alias("n"), F.min("pos").alias("first")))
    w = Window.partitionBy("method").orderBy(F.desc("n"), F.asc("first"))
    ranked = per.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
    return (ranked.join(first_methods, "method")
            .select("method", "rank", "category", "n", F.round(F.col("n") * 100.0 / F.col("count"), 1).alias("percent")))


# --------------------------------------------------------------------------- T10
def method_summary(results: DataFrame) -> DataFrame:
    """Per method: count, mean time, sorted categories and a category -> count map."""
    per_cat = results.groupBy("method", "category").agg(F.count("*").alias("n"))
    maps = per_cat.groupBy("method").agg(
        F.array_sort(F.collect_list("category")).alias("categories"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"))
    return _per_method(results).drop("categories_used", "first").join(maps, "method")


def method_summary_long(results: DataFrame) -> DataFrame:
    """Long form of the summary: one row per (method, category)."""
    per_cat = results.groupBy("method", "category").agg(F.count("*").alias("n"))
    return _per_method(results).select("method", "count", "avg_time").join(per_cat, "method")


# --------------------------------------------------------------------------- T11
def run_methods(df: DataFrame, methods: dict, keep: Sequence[str] = ("article_id",),
                limits: dict | None = None, order_col: str = "pos") -> DataFrame:
    """Run named methods over the same articles and stack the results (long form).

    ``methods`` maps a result name to a function DataFrame -> classified DataFrame.
    ``limits`` gives costly methods (paid model calls) only the first ``n``
    articles in ``order_col`` order.
    """
    limits = limits or {}
    out = None
    for name, fn in methods.items():
        src = df.orderBy(order_col).limit(limits[name]) if name in limits else df
        res = fn(src).select(*keep, "category", F.col("confidence").cast("double").alias("confidence"),
                             "method").withColumn("result", F.lit(name))
        out = res if out is None else out.unionByName(res)
    return out
