"""Nearest prototype among any number of prototypes.

``classify.classify_nearest`` holds all prototypes in one row, which is right for a
list of categories. Here they stay a table: cut into blocks of at most
``BLOCK_BYTES``, and for every block one matrix product per batch of articles
gives each article its best prototype of the block. A block is sent to the
tasks, its results are stored, and the block is given up before the next one is
read; the best of all blocks is a grouped maximum. No row, task or driver holds
more than a block, and the articles' vectors are never shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette import dims
from gazette.functions.vectors import norm
from gazette.session import ensure_checkpoint_dir, scratch_path, ship_package

BLOCK_BYTES = 32 << 20
ROWS = 4096                  # articles of one product
NEAR = 1e-9                  # products this close are a tie, which the lower ``ord`` wins


def _unit(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero vectors stay zero) of the non-null rows, and which rows these are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = np.flatnonzero(np.asarray(column.is_valid()))
    own = column.drop_null()
    m = np.asarray(own.flatten(), np.float64).reshape(len(own), -1) if len(own) else np.empty((0, 0))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n), valid


def _best_pass(shared):
    def run(batches):
        ords, protos = shared.value                           # by ord
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                m, valid = _unit(part.column("v"))
                if not len(valid):
                    continue
                d = m @ protos.T
                top = d.max(axis=1)
                first = (d >= top[:, None] - NEAR).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(valid)), pa.array(top), pa.array(ords[first])],
                                                 ["_row", "d", "ord"])
    return run


def classify_nearest_table(df: DataFrame, prototypes: DataFrame, vec_col: str = "vec", method: str = "nearest_prototype",
                           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with ``category, confidence, method`` of the prototype (``ord, category, vec``) with the highest cosine.

    Ties (within ``NEAR``) go to the lowest ``ord``. An article without a vector is ``unknown`` with confidence 0; a
    zero vector has similarity 0 to all prototypes. ``ord`` must not repeat.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    path = scratch_path(spark, "nearest-articles")
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    articles = spark.read.parquet(path)
    path = scratch_path(spark, "nearest-prototypes")
    prototypes.select(F.col("ord").cast("long").alias("ord"), "category", F.col("vec").cast("array<double>").alias("v")).write.parquet(path)
    protos = spark.read.parquet(path)
    size = protos.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    blocks = max(1, -(-size["n"] * (size["w"] or 0) * 8 // block_bytes))
    vectors = articles.select("_row", F.col(vec_col).cast("array<double>").alias("v"))
    parts = []
    for b in range(blocks):
        block = protos.filter(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == b).select("ord", "v").orderBy("ord").toArrow()
        if not block.num_rows:
            continue
        shared = sc.broadcast((np.asarray(block.column("ord")), _unit(block.column("v"))[0]))
        path = scratch_path(spark, "nearest-block")
        vectors.mapInArrow(_best_pass(shared), "_row long, d double, ord long").write.parquet(path)
        shared.destroy()
        parts.append(spark.read.parquet(path))
    if not parts:
        parts = [spark.createDataFrame([], "_row long, d double, ord long")]
    best = reduce(DataFrame.unionByName, parts)
    rounded = F.struct(F.round("d", 9), -F.col("ord"))
    best = best.groupBy("_row").agg(F.max_by(F.struct("d", "ord"), rounded).alias("_b")).select("_row", "_b.d", "_b.ord")
    found = best.join(protos.select("ord", F.col("category").alias("_category")), "ord")
    out = articles.join(found.select("_row", "d", "_category"), "_row", "left")
    n = norm(F.col(vec_col).cast("array<double>"))
    return (out.withColumn("category", F.coalesce("_category", F.lit(dims.UNKNOWN_CATEGORY)))
            .withColumn("confidence", F.when(n > 0, F.col("d")).otherwise(F.lit(0.0)))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
            .withColumn("method", F.lit(method)).drop("_row", "_category", "d"))
