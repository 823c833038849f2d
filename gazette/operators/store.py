"""Article / digest / history store on Parquet.

The store is a directory of Parquet files. Inserts append; updates write a new
version of the table (there is no in-place MERGE without a table format) and
the caller switches to the new path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette import dims
from gazette.session import path_exists

STORE_COLUMNS = ["title", "description", "url", "source", "published", "title_hash", "collected_at",
                 "language", "category", "is_relevant", "classification_confidence"]


# --------------------------------------------------------------------------- K1
def article_hash(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """``title_hash`` = MD5 hex of title followed by description."""
    return df.withColumn("title_hash", F.md5(F.concat(F.coalesce(F.col(title), F.lit("")),
                                                      F.coalesce(F.col(description), F.lit("")))))


# --------------------------------------------------------------------------- K2
def new_articles(batch: DataFrame, store: DataFrame, collected_at, order_col: str = "pos") -> DataFrame:
    """Rows of ``batch`` whose content hash is not yet stored, as store documents.

    Duplicates inside the batch keep the first by ``order_col`` (grouped
    ``min_by``, combined map-side). The store side is only read for its hash
    column; the anti join shuffles both sides on the hash.
    """
    hashed = article_hash(batch)
    cols = hashed.columns
    first = (hashed.groupBy("title_hash")
             .agg(F.min_by(F.struct(*[F.col(c) for c in cols if c != "title_hash"]), F.col(order_col)).alias("_r"))
             .select("title_hash", "_r.*"))
    fresh = first.join(store.select("title_hash"), "title_hash", "left_anti")
    get = lambda c, default=None: F.col(c) if c in cols else F.lit(default)
    return fresh.select(
        F.coalesce(get("title"), F.lit("")).alias("title"),
        F.coalesce(get("description"), F.lit("")).alias("description"),
        F.coalesce(get("url"), F.lit("")).alias("url"),
        F.coalesce(get("source"), F.lit("")).alias("source"),
        get("published").alias("published"), "title_hash",
        F.lit(collected_at).cast("timestamp").alias("collected_at"),
        get("language").cast("string").alias("language"),
        get("category").cast("string").alias("category"),
        F.coalesce(get("is_relevant"), F.lit(True)).alias("is_relevant"),
        get("classification_confidence").cast("double").alias("classification_confidence"),
        *([F.col(order_col)] if order_col in cols else []),
    )


def saved_ids(batch: DataFrame, store: DataFrame, id_col: str = "id", order_col: str = "pos") -> DataFrame:
    """For every batch row: the stored id when its hash exists, else null (a new row)."""
    hashed = article_hash(batch)
    ids = store.groupBy("title_hash").agg(F.min(id_col).alias("existing_id"))
    return hashed.join(ids, "title_hash", "left").select(order_col, "title_hash", "existing_id")


def read_store(spark, store_path: str) -> DataFrame:
    """The store at a path; an empty one if nothing is there yet. Any other read error is raised."""
    if not path_exists(spark, store_path):
        return spark.createDataFrame([], "title_hash string")
    return spark.read.parquet(store_path)


def save_articles(batch: DataFrame, store_path: str, collected_at, order_col: str = "pos") -> DataFrame:
    """Append new rows to the store at ``store_path``; returns the appended rows (lazy)."""
    fresh = new_articles(batch, read_store(batch.sparkSession, store_path), collected_at, order_col)
    fresh.write.mode("append").parquet(store_path)
    return fresh


# --------------------------------------------------------------------------- K4
def digest_record(dig: DataFrame, config: dict, created_at) -> DataFrame:
    """One store record per digest row: data, config map, counts, version (default 1.0)."""
    cfg = F.create_map(*[x for k, v in config.items() for x in (F.lit(str(k)), F.lit(str(v)))]) if config \
        else F.create_map().cast("map<string,string>")
    processed = F.col("articles_processed") if "articles_processed" in dig.columns else F.lit(0)
    return dig.select(
        F.struct(*[F.col(c) for c in dig.columns]).alias("digest_data"),
        cfg.alias("pipeline_config"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
        F.coalesce(F.col("language"), F.lit("unknown")).alias("language") if "language" in dig.columns
        else F.lit("unknown").alias("language"),
        F.size("items").cast("long").alias("events_count") if "items" in dig.columns
        else F.lit(0).cast("long").alias("events_count"),
        processed.cast("long").alias("articles_processed"),
        F.lit(str(config.get("version", dims.DEFAULT_RECORD_VERSION))).alias("pipeline_version"),
    )


def append_digest(dig: DataFrame, config: dict, created_at, path: str) -> None:
    """Appends the digest record to the table at ``path``."""
    digest_record(dig, config, created_at).write.mode("append").parquet(path)


# --------------------------------------------------------------------------- K5
def mark_processed(ids: DataFrame, config: dict, processed_at, id_col: str = "article_id") -> DataFrame:
    """Processing history: one row per article id with the run's config."""
    cfg = F.create_map(*[x for k, v in config.items() for x in (F.lit(str(k)), F.lit(str(v)))])
    return ids.select(F.col(id_col).cast("string").alias("article_id"),
                      F.lit(processed_at).cast("timestamp").alias("processed_at"),
                      F.lit(str(config.get("version", dims.DEFAULT_RECORD_VERSION))).alias("pipeline_version"),
                      cfg.alias("pipeline_config"))


def append_history(ids: DataFrame, config: dict, processed_at, path: str, id_col: str = "article_id") -> None:
    """Appends processing history to the table at ``path``."""
    mark_processed(ids, config, processed_at, id_col).write.mode("append").parquet(path)


# --------------------------------------------------------------------------- K6
def update_relevance(store: DataFrame, updates: DataFrame, updated_at, id_col: str = "id",
                     order_col: str | None = None) -> DataFrame:
    """New version of the store with relevance flag, confidence and time set for updated ids.

    Ids that are not stored are ignored (left join from the store side). Of
    several updates for one id the last by ``order_col`` counts (without it the
    largest values), so a stored row stays one row.
    """
    value = F.struct(F.col("is_relevant").alias("_rel"), F.col("relevance_confidence").alias("_conf"))
    last = F.max_by(value, F.col(order_col)) if order_col else F.max(value)
    up = updates.groupBy(F.col(id_col).alias("_uid")).agg(last.alias("_u")).select("_uid", "_u.*")
    out = store.join(up, store[id_col] == up["_uid"], "left")
    hit = F.col("_uid").isNotNull()
    base_conf = F.col("relevance_confidence") if "relevance_confidence" in store.columns else F.lit(None).cast("double")
    base_ts = F.col("relevance_updated_at") if "relevance_updated_at" in store.columns else F.lit(None).cast("timestamp")
    return (out.withColumn("is_relevant", F.when(hit, F.col("_rel")).otherwise(F.col("is_relevant")))
               .withColumn("relevance_confidence", F.when(hit, F.col("_conf")).otherwise(base_conf))
               .withColumn("relevance_updated_at", F.when(hit, F.lit(updated_at).cast("timestamp")).otherwise(base_ts))
               .drop("_uid", "_rel", "_conf"))


def write_relevance_version(store_path: str, updates: DataFrame, updated_at, new_path: str, id_col: str = "id",
                            order_col: str | None = None) -> None:
    """Writes the updated store as a new version at ``new_path``; the caller switches to it."""
    store = updates.sparkSession.read.parquet(store_path)
    update_relevance(store, updates, updated_at, id_col, order_col).write.parquet(new_path)


# --------------------------------------------------------------------------- S2
def get_articles(store: DataFrame, limit: int | None = 100, category: str | None = None, source: str | None = None,
                 date_from=None, is_relevant: bool | None = None, id_col: str = "id") -> DataFrame:
    """Filtered read, newest first (missing dates last), then ``limit``.

    ``category`` matches a label in ``meta.labels``; ``source`` is a
    case-insensitive regex on the url; ``date_from`` is inclusive. Filters are
    plain predicates, so Parquet pushdown applies to the date bound.
    """
    out = store
    if category:
        out = out.filter(F.array_contains(F.col("meta.labels"), category))
    if source:
        out = out.filter(F.col("url").rlike("(?i)" + source))
    if date_from is not None:
        out = out.filter(F.col("publish_date") >= F.lit(date_from).cast(store.schema["publish_date"].dataType))
    if is_relevant is not None:
        out = out.filter(F.col("is_relevant") == is_relevant)
    if limit is None:          # a whole-table read needs no global sort
        return out
    return out.orderBy(F.desc_nulls_last("publish_date"), F.asc(id_col)).limit(limit)


# --------------------------------------------------------------------------- S3
def normalize_store_articles(df: DataFrame, language: str = "english") -> DataFrame:
    """Store documents -> articles: summary as description, host of the url as source."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.get(F.split(url, "/"), 2)
    return df.select(
        *([F.col("id")] if "id" in df.columns else []),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("summary"), F.lit("")).alias("description"),
        url.alias("url"),
        F.when(url == "", F.lit("unknown")).otherwise(F.coalesce(host, F.lit("unknown"))).alias("source"),
        F.col("publish_date").alias("published"),
        F.lit(language).alias("language"),
    )


# --------------------------------------------------------------------------- S4
def get_digests(digests: DataFrame, limit: int | None = 10, language: str | None = None,
                id_col: str = "digest_id") -> DataFrame:
    """Latest digests, optional language filter, id as a string."""
    out = digests
    if language:
        out = out.filter(F.col("language") == language)
    out = out.withColumn(id_col, F.col(id_col).cast("string")).orderBy(F.desc("created_at"), F.asc(id_col))
    return out.limit(limit) if limit is not None else out
