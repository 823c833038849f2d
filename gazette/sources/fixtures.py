"""Article-shaped views over the driver's parquet tables.

Only the columns a query asks for are joined in: an outer join whose columns
are unused cannot be removed by the optimiser (it does not know the key is
unique), so callers choose ``with_*`` flags. All joins are on the document id,
so at scale every input is hash-partitioned once on that key and the joins
share the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette import dims
from gazette.functions.text import trim_ws
from gazette.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(docs: DataFrame, extra: list[str], with_text: bool) -> DataFrame:
    head = F.substring(F.substring_index("text", "\n", 1), 1, 120)
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.col("doc_id").alias("pos"),
        trim_ws(head).alias("title"),
        trim_ws(F.expr("substr(text, length(substring(substring_index(text, '\n', 1), 1, 120)) + 1)"))
        .alias("description"),
        "source",
        F.regexp_extract("source", r"(\d+)$", 1).try_cast("int").alias("source_ord"),
        F.col("lang").alias("language"),
        *(["text"] if with_text else []),
        *extra,
    )


def articles(spark: SparkSession, sf_dir: str, with_published: bool = True, with_url: bool = True,
             with_labels: bool = True, with_text: bool = False, extra_cols=None) -> DataFrame:
    """``article_id, pos, title, description, source, language [, url, published, labels]``.

    Title = first line of the document cut at 120 code points, description =
    the rest of the text; both stripped. Nothing of the text is dropped.
    ``source_ord`` is the number in the source's name. ``extra_cols`` (a DataFrame
    keyed by ``doc_id``) adds its other columns; documents without a row there stay.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    extra = []
    if extra_cols is not None:
        docs = docs.join(extra_cols, "doc_id", "left")
        extra = [c for c in extra_cols.columns if c != "doc_id"]
    df = _project(docs, extra, with_text)
    if with_url:
        pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("article_id"), "url")
        df = df.join(pages, "article_id", "left")
    if with_published:
        ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("article_id"),
                                                   F.col("ts").alias("published"))
        df = df.join(ev, "article_id", "left")
    if with_labels:
        lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), "quality", "toxic")
        df = (df.join(lab, "article_id", "left")
              .withColumn("labels", F.when(F.col("quality").isNotNull(), F.array_compact(F.array(
                  F.when(F.col("quality") == 1, F.lit("quality")),
                  F.when(F.col("toxic") == 1, F.lit("toxic"))))))
              .drop("quality", "toxic"))
    return df


def article_vectors(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """All articles with their embedding (``vec`` as array<double>, null without one) and ``label``."""
    kw.setdefault("with_published", False)
    kw.setdefault("with_url", False)
    kw.setdefault("with_labels", False)
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return articles(spark, sf_dir, extra_cols=emb, **kw)


def labelled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(category, label, vec)`` of the embeddings that belong to a document.

    The same rows as ``labelled_vectors`` without touching any text: a semi join
    on the document ids only (used to build prototypes).
    """
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    emb = table(spark, sf_dir, "embeddings").join(ids, "vec_id", "left_semi")
    return emb.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), "label",
                      F.col("embedding").cast("array<double>").alias("vec"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article vectors with category ``c{label}`` taken from the given label."""
    return (article_vectors(spark, sf_dir)
            .withColumn("category", F.concat(F.lit("c"), F.col("label").cast("string"))))


def method_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form classification results derived from ``events``.

    method = event_type, article = user_id (so every article gets votes from
    several methods), category = one of the basic categories, time = value,
    confidence in [0, 1), pos = event_id (order in which results arrived).
    """
    cats = F.array(*[F.lit(c) for c, _ in dims.BASIC_CATEGORIES])
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("method"),
        F.col("user_id").alias("article_id"),
        F.col("event_id").alias("pos"),
        F.try_element_at(cats, (F.col("event_id") % 9 + 1).cast("int")).alias("category"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"),
        F.col("value").alias("time"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return (conv.filter(F.col("role") == "assistant")
            .select("conv_id", "turn", F.col("text").alias("answer")))


def store_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existing article store: labelled documents, stored with store field names.

    ``is_relevant`` comes from the quality label, ``category`` from the keyword
    classifier with the fixture dictionaries.
    """
    from gazette.operators.classify import classify_keyword
    from gazette.operators.store import article_hash
    # one join with the labels gives the filter, the flag and the label list
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    arts = articles(spark, sf_dir, with_labels=False, extra_cols=lab)
    stored = arts.filter(F.col("quality").isNotNull()).withColumn("labels", F.array_compact(F.array(
        F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic")))))
    stored = classify_keyword(stored, dims.FIXTURE_CATEGORY_KEYWORDS, text_col=None)
    stored = article_hash(stored)
    return stored.select(
        F.col("article_id").cast("string").alias("id"), "article_id", "title",
        F.col("description").alias("summary"), "url", "source",
        F.col("published").alias("publish_date"), "language", "title_hash", "category",
        (F.col("quality") == 1).alias("is_relevant"),
        F.col("confidence").alias("classification_confidence"),
        F.struct(F.col("labels").alias("labels")).alias("meta"),
    )


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest records derived from the articles: one per publication day."""
    arts = articles(spark, sf_dir, with_url=False, with_labels=False).filter(F.col("published").isNotNull())
    return (arts.groupBy(F.to_date("published").alias("day"))
            .agg(F.max("published").alias("created_at"),
                 F.count("*").alias("articles_processed"),
                 F.count_if(F.col("language") != "en").alias("n_other"),
                 F.count_if(F.col("language") == "en").alias("n_en"),
                 F.countDistinct("source").alias("events_count"))
            .select(F.date_format("day", "yyyy-MM-dd").alias("digest_id"), "created_at",
                    F.when(F.col("n_other") > F.col("n_en"), "russian").otherwise("english").alias("language"),
                    F.col("events_count").cast("long").alias("events_count"), "articles_processed"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled training rows: quality label joined to article text."""
    from gazette.functions.text import compose_text
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), "quality")
    arts = articles(spark, sf_dir, with_url=False, with_published=False, with_labels=False)
    return (arts.join(lab, "article_id")
            .select("article_id", compose_text().alias("text"),
                    F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label")))
