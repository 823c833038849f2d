"""Classification.

Fixed dimension tables (keyword lists, description and hierarchy maps) are
literals; category prototypes come from a table as one aggregated row (a
scalar subquery). So every classifier is a projection over the articles: no
join, no shuffle, no driver-side collection while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette import dims
from gazette.functions.text import compose_text, keyword_hits, sql_double, sql_str, str_array
from gazette.functions.vectors import dot, norm
from gazette.operators.dictionary import SHORT, dictionary_hits
from gazette.operators.relevance import check_relevance


def _text(text_col):
    return compose_text() if text_col is None else F.col(text_col)


# --------------------------------------------------------------------------- C1
def classify_keyword(df: DataFrame, cat_keywords=dims.CATEGORY_KEYWORDS, text_col: str | None = None,
                     default: str = dims.DEFAULT_CATEGORY, method: str = "keyword_based") -> DataFrame:
    """Per-category count of contained keywords; argmax, first category wins ties.

    No hit at all -> ``default`` with confidence 0.0 (zero hits over any list).
    More than ``SHORT`` keywords are matched in one pass of the text.
    """
    if sum(len(kws) for _, kws in cat_keywords) > SHORT:
        return _classify_dictionary(df, cat_keywords, text_col, default, method)
    out = df.withColumn("_lt", F.lower(_text(text_col)))
    scores = F.array(*[
        F.struct(keyword_hits("_lt", kws, lowered=True).alias("hits"), F.lit(-i).alias("neg_ord"),
                 F.lit(c).alias("category"), F.lit(len(kws)).alias("n"))
        for i, (c, kws) in enumerate(cat_keywords)])
    best = F.array_max(scores)
    return (out.withColumn("_best", best)
               .withColumn("category", F.when(F.col("_best.hits") > 0, F.col("_best.category"))
                           .otherwise(F.lit(default)))
               .withColumn("confidence", F.when(F.col("_best.hits") > 0,
                                                F.least(F.lit(1.0), F.col("_best.hits") / F.col("_best.n")))
                           .otherwise(F.lit(0.0)))
               .withColumn("method", F.lit(method))
               .drop("_lt", "_best"))


def _classify_dictionary(df: DataFrame, cat_keywords, text_col, default: str, method: str) -> DataFrame:
    """The same over the counts of ``dictionary_hits``: only categories with a hit are compared."""
    out = dictionary_hits(df, [kws for _, kws in cat_keywords], F.lower(_text(text_col)), "_hits")
    best = F.array_max(F.transform("_hits", lambda h: F.struct(h["n"].alias("n"), (-h["grp"]).alias("neg"))))
    names = str_array([c for c, _ in cat_keywords])
    sizes = F.expr("array(" + ", ".join(str(len(kws)) for _, kws in cat_keywords) + ")")
    at = -F.col("_best.neg")
    return (out.withColumn("_best", best)
               .withColumn("category", F.coalesce(F.get(names, at), F.lit(default)))
               .withColumn("confidence", F.when(at.isNotNull(), F.least(F.lit(1.0), F.col("_best.n") / F.get(sizes, at)))
                           .otherwise(F.lit(0.0)))
               .withColumn("method", F.lit(method))
               .drop("_hits", "_best"))


# --------------------------------------------------------------------------- C3
def build_prototypes(df: DataFrame, label_col: str = "category", vec_col: str = "vec",
                     ord_col: str | None = None) -> DataFrame:
    """Mean vector per label: ``(ord, category, vec)``.

    ``posexplode`` + grouped ``avg`` aggregates partially on the map side, so a
    label holding most rows is combined per task before the shuffle. ``ord``
    defaults to the label order.
    """
    exploded = df.select(F.col(label_col).alias("category"),
                         *([F.col(ord_col).alias("ord")] if ord_col else []),
                         F.posexplode(vec_col).alias("i", "x"))
    keys = ["category"] + (["ord"] if ord_col else [])
    per_dim = exploded.groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    protos = (per_dim.groupBy(*keys)
              .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_v"))
              .select(*keys, F.transform("_v", lambda s: s["x"]).alias("vec")))
    if not ord_col:
        from pyspark.sql import Window
        protos = protos.withColumn("ord", F.row_number().over(Window.orderBy("category")) - 1)
    return protos.select(F.col("ord").cast("int").alias("ord"), "category", "vec")


def prototypes_from_descriptions(desc_vectors: DataFrame) -> DataFrame:
    """Prototypes when vectors of the category descriptions are given: ``(ord, category, vec)``."""
    return desc_vectors.select(F.col("ord").cast("int"), "category", F.col("vec").cast("array<double>"))


def prototype_array(protos) -> Column:
    """The prototypes as one array of ``(ord, category, vec)`` with unit vectors.

    Accepts a DataFrame (aggregated to one row when the query runs) or a list
    of such tuples.
    """
    if isinstance(protos, DataFrame):
        n = norm("vec")
        unit = F.transform("vec", lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))
        row = F.struct(F.col("ord").cast("int").alias("ord"), F.col("category").cast("string").alias("category"),
                       unit.alias("vec"))
        return protos.agg(F.array_sort(F.collect_list(row)).alias("protos")).scalar()
    rows = sorted(protos, key=lambda r: r[0])
    items = []
    for o, c, v in rows:
        a = np.asarray(v, dtype=np.float64)
        n = np.linalg.norm(a)
        a = a / n if n > 0 else a * 0.0
        vec = "array(" + ", ".join(sql_double(x) for x in a) + ")"
        items.append(f"named_struct('ord', {int(o)}, 'category', {sql_str(c)}, 'vec', {vec})")
    return F.expr("array(" + ", ".join(items) + ")")


# --------------------------------------------------------------------------- C2
def classify_nearest(df: DataFrame, prototypes, vec_col: str = "vec", method: str = "nearest_prototype",
                     out_category: str = "category", out_conf: str = "confidence") -> DataFrame:
    """Cosine to every prototype, argmax (first wins ties); confidence = similarity.

    Prototypes are unit vectors, so the argmax of the cosine is the argmax of
    the raw dot product; the article's norm (a positive per-row constant) is
    applied once afterwards, outside any lambda. An article without a vector is
    ``unknown`` with confidence 0.
    """
    df = df.withColumn("_protos", prototype_array(prototypes))
    best = F.array_max(F.transform("_protos", lambda p: F.struct(
        F.coalesce(dot(F.col(vec_col), p["vec"]), F.lit(0.0)).alias("d"), (-p["ord"]).alias("neg_ord"),
        p["category"].alias("category"))))
    n = norm(vec_col)
    return (df.withColumn("_best", best)
              .withColumn(out_category, F.when(F.col(vec_col).isNull(), F.lit(dims.UNKNOWN_CATEGORY))
                          .otherwise(F.col("_best.category")))
              .withColumn(out_conf, F.when(n > 0, F.col("_best.d") / n).otherwise(F.lit(0.0)))
              .withColumn("method", F.lit(method))
              .drop("_best", "_protos"))


def score_table(df: DataFrame, prototypes, id_col: str = "article_id", vec_col: str = "vec",
                labels: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(id, ord, label, score)``: cosine of each vector to each prototype."""
    df = df.withColumn("_protos", prototype_array(prototypes))
    out = df.select(id_col, norm(vec_col).alias("_n"), F.explode(F.transform("_protos", lambda p: F.struct(
        p["ord"].alias("ord"), p["category"].alias("label"),
        F.coalesce(dot(F.col(vec_col), p["vec"]), F.lit(0.0)).alias("d")))).alias("s"))
    out = out.select(id_col, "s.ord", "s.label",
                     F.when(F.col("_n") > 0, F.col("s.d") / F.col("_n")).otherwise(F.lit(0.0)).alias("score"))
    if labels is not None:
        out = out.withColumn("label", F.try_element_at(str_array(labels), F.col("ord") + 1))
    return out


# --------------------------------------------------------------------------- C4
def top_label(scores: DataFrame, id_col: str = "article_id", method: str = "zero_shot") -> DataFrame:
    """Best label per id from a score table; ties go to the lower ``ord``."""
    return (scores.groupBy(id_col)
            .agg(F.max_by(F.struct(F.col("label").alias("category"), F.col("score").alias("confidence")),
                          F.struct(F.col("score"), -F.col("ord"))).alias("_b"))
            .select(id_col, "_b.category", "_b.confidence")
            .withColumn("method", F.lit(method)))


# --------------------------------------------------------------------------- C5
def label_from_description(df: DataFrame, desc_col: str = "category", cats=dims.BASIC_CATEGORIES,
                           default: str = dims.DEFAULT_CATEGORY) -> DataFrame:
    """Map a winning description text back to its category (literal map), default ``world``."""
    m = F.create_map(*[x for c, d in cats for x in (F.lit(d), F.lit(c))])
    return df.withColumn("category", F.coalesce(F.try_element_at(m, F.col(desc_col)), F.lit(default)))


# --------------------------------------------------------------------------- C6
def vote_weighted(results: DataFrame, id_col: str = "article_id", fallback: DataFrame | None = None) -> DataFrame:
    """Confidence-weighted vote across methods.

    Per (id, category): sum and mean of confidence, first arrival (``pos``).
    Winner: largest sum (compared at 1e-9, so float summation order cannot
    break a tie), ties to the category predicted first. Confidence is
    the mean confidence of the winner's voters; ``method = ensemble_{n}models``.
    Both aggregations combine partially before their shuffles. Ids without
    any vote take the ``fallback`` result when one is given.
    """
    per_cat = (results.groupBy(id_col, "category")
               .agg(F.sum("confidence").alias("s"), F.avg("confidence").alias("m"),
                    F.min("pos").alias("first"), F.count("*").alias("n")))
    voted = (per_cat.groupBy(id_col)
             .agg(F.max_by(F.struct("category", "m"), F.struct(F.round("s", 9), -F.col("first"))).alias("_w"),
                  F.sum("n").alias("n"))
             .select(id_col, F.col("_w.category").alias("category"), F.col("_w.m").alias("confidence"),
                     F.concat(F.lit("ensemble_"), F.col("n").cast("string"), F.lit("models")).alias("method")))
    if fallback is not None:
        fb = fallback.join(voted.select(id_col), id_col, "left_anti").select(id_col, "category", "confidence",
                                                                             "method")
        voted = voted.unionByName(fb)
    return voted


# --------------------------------------------------------------------------- C7
def label_from_answer(df: DataFrame, answer_col: str = "answer", cats: Sequence[str] | None = None,
                      model: str = "model", default: str = dims.DEFAULT_CATEGORY) -> DataFrame:
    """First category (list order) contained in ``lower(strip(answer))``; confidence 0.8.

    A failed call (null answer) gives ``default``, 0.0 and an ``_error`` method.
    """
    from gazette.functions.text import trim_ws
    names = cats if cats is not None else [c for c, _ in dims.BASIC_CATEGORIES]
    ans = F.lower(trim_ws(F.col(answer_col)))
    hit = F.try_element_at(F.filter(str_array(names), lambda c: F.instr(ans, c) > 0), F.lit(1))
    model_name = model.split("/")[-1]
    failed = F.col(answer_col).isNull()
    return (df.withColumn("category", F.when(failed, F.lit(default)).otherwise(F.coalesce(hit, F.lit(default))))
              .withColumn("confidence", F.when(failed, F.lit(0.0)).otherwise(F.lit(0.8)))
              .withColumn("method", F.when(failed, F.lit(f"llm_{model_name}_error"))
                          .otherwise(F.lit(f"llm_{model_name}"))))


# --------------------------------------------------------------------------- C8
def classify_gated(df: DataFrame, prototypes, irrelevant=dims.IRRELEVANT_KEYWORDS, relevant=dims.RELEVANT_KEYWORDS,
                   vec_col: str = "vec", text_col: str | None = None, method: str = "nearest_prototype",
                   min_confidence: float | None = None) -> DataFrame:
    """Relevance gate, then nearest-prototype classification of relevant rows only.

    The gate takes the vector away from irrelevant rows before they are scored,
    and a missing vector costs no products, so only relevant rows are scored
    without a split and a join back.
    ``min_confidence`` (off by default) turns low-confidence relevant rows irrelevant.
    """
    gated = check_relevance(df, irrelevant, relevant, text_col)
    if min_confidence is not None:
        gated = gated.withColumn("is_relevant", F.col("is_relevant") &
                                 (F.col("relevance_confidence") >= F.lit(min_confidence)))
    gated = gated.withColumn("_gated", F.when(F.col("is_relevant"), F.col(vec_col)))
    classified = classify_nearest(gated, prototypes, "_gated", method, "_cat", "_conf")
    return (classified
            .withColumn("category", F.when(F.col("is_relevant"), F.col("_cat")).otherwise(F.lit(dims.IRRELEVANT_CATEGORY)))
            .withColumn("confidence", F.when(F.col("is_relevant"), F.col("_conf")).otherwise(F.lit(0.0)))
            .drop("_cat", "_conf", "_gated"))


# --------------------------------------------------------------------------- C9
def main_category(df: DataFrame, hierarchy=dims.CATEGORY_HIERARCHY, sub_col: str = "category",
                  default: str = dims.OTHER_MAIN_CATEGORY) -> DataFrame:
    """Sub-category -> main category via a literal map (first main wins), default ``other``."""
    seen, pairs = set(), []
    for main, subs in hierarchy:
        for s in subs:
            if s not in seen:
                seen.add(s)
                pairs += [F.lit(s), F.lit(main)]
    m = F.create_map(*pairs)
    return df.withColumn("main_category", F.coalesce(F.try_element_at(m, F.col(sub_col)), F.lit(default)))


def category_rollup(df: DataFrame, sub_col: str = "category") -> DataFrame:
    """Counts per (main, sub) with ROLLUP subtotals (one grouping-set aggregation)."""
    return (main_category(df, sub_col=sub_col)
            .rollup("main_category", F.col(sub_col).alias("sub_category"))
            .agg(F.count("*").alias("articles")))


# --------------------------------------------------------------------------- C14
def training_rows(dim_df: DataFrame, replicate: int = 3, text_col: str = "description",
                  label_col: str = "category") -> DataFrame:
    """Descriptions replicated ``replicate`` times as a training set."""
    return (dim_df.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), "ord",
                          F.explode(F.sequence(F.lit(1), F.lit(replicate))).alias("copy")))


# --------------------------------------------------------------------------- C15
def registry() -> dict[str, Callable[..., DataFrame]]:
    """Named classification methods: DataFrame -> DataFrame with category, confidence, method."""
    from gazette.operators import ml, nearest
    return {
        "keyword": classify_keyword,
        "nearest": classify_nearest,
        "nearest_table": nearest.classify_nearest_table,
        "gated": classify_gated,
        "answer": label_from_answer,
        "vote": vote_weighted,
        "tfidf_nb": ml.classify_nb,
        "tfidf_svm": ml.classify_svm,
        "tfidf_rf": ml.classify_rf,
        "tfidf_ensemble": ml.classify_soft_vote,
    }


def classify(df: DataFrame, method: str, **ctx) -> DataFrame:
    """Dispatch a named method; unknown names raise ``ValueError``."""
    reg = registry()
    if method not in reg:
        raise ValueError(f"Unknown method: {method}")
    return reg[method](df, **ctx)
