"""Incremental article ingestion (K3) with Structured Streaming.

Articles that land as files (Parquet, JSON, or RSS feeds) go into a
``HashStore``. The query keeps one state per content hash (RocksDB state store):
an article passes when its hash is new. When the query first starts, the hashes
that the store holds become its state, as a second source; after that a batch reads
its own files and its keys' states, and nothing of the store.

Of equal hashes in a batch the first by ``order_col`` passes. A batch is
published in the store under the query's folder and its number, once: run again
after a failure it gives the same rows, and a batch that is published already
is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DataType, StringType, StructType

from gazette.operators.hash_store import PREFIX, HashStore
from gazette.operators.store import article_hash, new_articles
from gazette.session import path_exists

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def sort_text(c: Column, kind: DataType) -> Column:
    """A string that sorts like the value: numbers from 0 on, strings, and structs of them; nulls last."""
    if isinstance(kind, StructType):
        return F.concat_ws("\0", *[sort_text(c[f.name], f.dataType) for f in kind.fields])
    text = c.cast("string") if isinstance(kind, StringType) else F.format_string("%020d", c.cast("long"))
    return F.when(c.isNull(), F.lit("\U0010ffff")).otherwise(text)


def _first_new(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first article of a hash that has no state yet and is not in the store."""
    stored, best = state.exists, None
    for rows in frames:
        stored = stored or bool(rows["seed"].any())
        for order, payload in zip(rows["ord"], rows["payload"], strict=True):
            if payload is not None and (best is None or order < best[0]):
                best = (order, payload)
    if not state.exists:
        state.update((True,))
    if not stored and best is not None:
        yield pd.DataFrame({"payload": [best[1]]})


def ingest(stream: DataFrame, store: HashStore, checkpoint_dir: str, order_col: str = "pos", available_now: bool = True):
    """Starts the ingestion of a streaming frame of articles; returns the ``StreamingQuery``.

    ``available_now`` processes everything that has landed and stops (batch-like scheduling with streaming
    bookkeeping); otherwise the query keeps polling.
    """
    spark = store.spark
    seeds = f"{checkpoint_dir.rstrip('/')}/seeds"
    if not path_exists(spark, seeds):                          # the store as the query finds it at its first start
        store.articles().select("title_hash").write.parquet(seeds)
    schema = stream.schema
    arrived = article_hash(stream).select(
        "title_hash", F.lit(False).alias("seed"), sort_text(F.col(order_col), schema[order_col].dataType).alias("ord"),
        F.to_json(F.struct(*[F.col(c) for c in schema.names]), JSON).alias("payload"))
    known = spark.readStream.schema("title_hash string").parquet(seeds).select(
        "title_hash", F.lit(True).alias("seed"), F.lit("").alias("ord"), F.lit(None).cast("string").alias("payload"))
    fresh = arrived.unionByName(known).groupBy("title_hash").applyInPandasWithState(
        _first_new, "payload string", "stored boolean", "append", GroupStateTimeout.NoTimeout)

    def publish(batch: DataFrame, number: int) -> None:
        origin = f"{checkpoint_dir}/{number}"
        if store.published(origin):                            # stored before; the run still has to commit its states
            batch.write.format("noop").mode("overwrite").save()
            return
        rows = batch.select(F.from_json("payload", schema, JSON).alias("r")).select("r.*")
        none = batch.sparkSession.createDataFrame([], "title_hash string")
        store.load(new_articles(rows, none, F.current_timestamp(), order_col).drop(order_col), origin)

    writer = fresh.writeStream.outputMode("append").foreachBatch(publish).option("checkpointLocation", f"{checkpoint_dir}/query")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:                                                   # the query has its own copy of the setting
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def ingest_stream(spark: SparkSession, landing_dir: str, schema: StructType, store_path: str, checkpoint_dir: str,
                  fmt: str = "parquet", available_now: bool = True, prefix: int = PREFIX):
    """``ingest`` of typed files below ``landing_dir``."""
    stream = spark.readStream.schema(schema).format(fmt).load(landing_dir)
    return ingest(stream, HashStore(spark, store_path, prefix), checkpoint_dir, available_now=available_now)


def ingest_feeds(spark: SparkSession, feed_dir: str, store_path: str, checkpoint_dir: str, source: str | None = None,
                 available_now: bool = True, prefix: int = PREFIX):
    """``ingest`` of RSS files below ``feed_dir`` (S1), in feed order."""
    from gazette.sources.feeds import stream_feeds
    stream = stream_feeds(spark, feed_dir, source)
    return ingest(stream, HashStore(spark, store_path, prefix), checkpoint_dir, available_now=available_now)
