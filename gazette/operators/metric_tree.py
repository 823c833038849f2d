"""A metric tree over unit vectors: blocks of near rows, and the pairs of blocks that may hold a pair within eps.

Rows of a key are split by pivots, level by level: each node larger than a
block draws ``FANOUT`` pivots that lie far apart from a sample of its rows, and
every row goes to the nearest one. A node knows its pivot and the largest
angle of its rows to it (its ball). Angles on the sphere obey the triangle
inequality, so two balls whose centres are further apart than both radii and
the angle of eps hold no pair; nor do any of their children. Pairs of nodes
are followed from the root downwards and dropped as soon as that holds, so
only the pairs that remain between leaves (tiles) are ever laid.

Scale: a level is one pass over the rows of the nodes that are still split,
dealt over tasks by (node, hash of the row) with the node's pivots beside them,
so a hot key or node is no single task. Levels grow with the logarithm of the
largest key. Keys that fit a block need no pass at all. Rows that no pivot
separates (equal vectors) are cut into parts by hash; all parts are paired.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions.vectors import dot
from gazette.session import ensure_checkpoint_dir, scratch_path

FANOUT = 16
SAMPLE = 256                 # rows of a node from which its pivots are drawn
CHUNK = 8192                 # rows of a node that are assigned in one task, about
LEVELS = 9                   # 16^9 leaves; numbers of nodes stay below 2^41
PARTS = 1 << 22              # block number = node * PARTS + part of the node
SLACK = 1e-6                 # for rounded angles
BUNDLE = 2048                # rows up to which the blocks below a node are laid together


def unit(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    """The vectors of a column as unit rows (zero vectors stay zero)."""
    vec = table.column(column)
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    m = np.asarray(vec.flatten(), np.float64).reshape(len(vec), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _pivots(table: pa.Table) -> pa.Table:
    """Of a node's sample the first row, then again and again the row farthest from all chosen ones."""
    order = np.lexsort((np.asarray(table.column("id")), np.asarray(table.column("_r"))))
    m = unit(table, "v")[order]
    chosen, best = [0], m @ m[0]
    while len(chosen) < min(FANOUT, len(m)):
        far = int(np.argmin(best))
        if best[far] >= 1.0 - 1e-12:
            break                                          # all others equal a chosen one
        chosen.append(far)
        best = np.maximum(best, m @ m[far])
    k = len(chosen)
    return pa.table({"k": pa.array([table.column("k")[0].as_py()] * k, table.schema.field("k").type),
                     "node": pa.array([table.column("node")[0].as_py()] * k, pa.int64()),
                     "c": pa.array(range(k), pa.int32()), "center": pa.array(list(m[chosen]), pa.list_(pa.float64()))})


def _assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Every row with its nearest pivot's node and the angle to the pivot."""
    center = unit(pivots, "center")
    c = np.asarray(pivots.column("c"))
    near = np.clip(unit(rows, "v") @ center.T, -1.0, 1.0) if rows.num_rows else np.empty((0, len(c)))
    best = near.argmax(axis=1) if rows.num_rows else np.empty(0, np.int64)
    child = np.asarray(rows.column("node"), np.int64) * FANOUT + 1 + c[best]
    angle = np.arccos(near[np.arange(len(best)), best]) if rows.num_rows else np.empty(0)
    return pa.table({"k": rows.column("k"), "id": rows.column("id"), "v": rows.column("v"),
                     "node": pa.array(child, pa.int64()), "angle": pa.array(angle, pa.float64())})


@dataclass
class Blocks:
    """``rows``: ``k, id, v, blk``; ``nodes``: ``k, node, parent, n, center, radius, leaf, parts`` (None if every key
    is one block)."""

    rows: DataFrame
    nodes: DataFrame | None
    block_size: int

    def tiles(self, eps: float) -> DataFrame | None:
        """``k, lo, hi``: the pairs of blocks (each with itself) that may hold two rows within eps; None if every key
        is one block. A zero vector is at distance 1 from all others, so nothing is dropped from eps 1 on."""
        return None if self.nodes is None else _tiles(self.nodes, eps)

    def bundles(self) -> Blocks:
        """The same rows with the blocks below a node of at most ``BUNDLE`` rows as one block.

        A row goes to every tile of its block, and tiles grow with the square of the blocks; of bundles there are as few
        as of blocks of ``BUNDLE`` rows, however small the leaves. A bundle has the ball of its node.
        """
        if self.nodes is None or self.block_size >= BUNDLE:
            return self
        above = self.nodes.select("k", F.col("node").alias("parent"), F.col("n").alias("_up"))
        kept = self.nodes.join(above, ["k", "parent"], "left").filter(F.col("parent").isNull() | (F.col("_up") > BUNDLE))
        small = F.col("n") <= BUNDLE
        nodes = _stored(kept.select("k", "node", "parent", "n", "center", "radius", (F.col("leaf") | small).alias("leaf"),
                                    F.when(small, F.lit(1)).otherwise(F.col("parts")).alias("parts")), "tree-nodes")
        line = [F.col("node")]                          # a leaf and the nodes above it
        for _ in range(LEVELS):
            line.append(F.when(line[-1] > 0, F.floor((line[-1] - 1) / F.lit(FANOUT)).cast("long")))
        leaves = self.nodes.filter("leaf").select("k", "node", F.explode(F.array_compact(F.array(*line))).alias("_head"))
        heads = nodes.filter(small).select("k", F.col("node").alias("_head"))
        rows = self.rows.withColumn("node", F.floor(F.col("blk") / F.lit(PARTS)).cast("long"))
        rows = rows.join(leaves.join(heads, ["k", "_head"]), ["k", "node"], "left")
        rows = rows.select("k", "id", "v", F.coalesce(F.col("_head") * PARTS, F.col("blk")).alias("blk"))
        return Blocks(_stored(rows, "tree-bundles"), nodes, BUNDLE)


def _tiles(nodes: DataFrame, eps: float) -> DataFrame:
    reach = math.acos(1.0 - eps) + SLACK if eps < 1.0 else math.inf
    pairs = _descend(nodes, reach)
    parts = nodes.filter("leaf").select("k", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    side = lambda n, p: parts.select("k", F.col("node").alias(n), (F.col("node") * PARTS + F.col("part")).alias(p))
    tiles = pairs.join(side("a", "lo"), ["k", "a"]).join(side("b", "hi"), ["k", "b"]).filter("lo <= hi")
    return tiles.select("k", "lo", "hi")


def _descend(nodes: DataFrame, reach: float) -> DataFrame:
    """``k, a, b``: pairs of leaves (``a <= b``) whose balls, and all balls above them, are within reach."""
    spark = nodes.sparkSession
    ball = nodes.select("k", "node", "parent", "center", "radius", "leaf")
    # what a node becomes one level down: its children, or itself if it is a leaf
    down = ball.filter("parent IS NOT NULL").select("k", F.col("parent").alias("up"), "node", "center", "radius", "leaf").unionByName(
        ball.filter("leaf").select("k", F.col("node").alias("up"), "node", "center", "radius", "leaf"))
    x = down.toDF("k", "a", "xn", "xc", "xr", "xl")
    y = down.toDF("k", "b", "yn", "yc", "yr", "yl")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("xc", "yc"))))
    found = [ball.filter("node = 0 AND leaf").select("k", F.col("node").alias("a"), F.col("node").alias("b"))]
    front = ball.filter("node = 0 AND NOT leaf").select("k", F.col("node").alias("a"), F.col("node").alias("b"))
    while True:
        step = front.join(x, ["k", "a"]).join(y, ["k", "b"]).filter((F.col("a") != F.col("b")) | (F.col("xn") <= F.col("yn")))
        if math.isfinite(reach):
            step = step.filter((F.col("xn") == F.col("yn")) | (angle <= F.col("xr") + F.col("yr") + reach))
        path = scratch_path(spark, "tree-pairs")
        step.select("k", F.least("xn", "yn").alias("a"), F.greatest("xn", "yn").alias("b"),
                    (F.col("xl") & F.col("yl")).alias("done")).write.parquet(path)
        stored = spark.read.parquet(path)
        found.append(stored.filter("done").select("k", "a", "b"))
        front = stored.filter("NOT done").select("k", "a", "b")
        if front.limit(1).count() == 0:
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def build(points: DataFrame, block_size: int) -> Blocks:
    """The blocks of ``points`` (``k, id, v``; read several times, so pass a stored or checkpointed frame)."""
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    points = points.select("k", "id", "v")
    sizes = points.groupBy("k").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > block_size)
    if large.limit(1).count() == 0:
        return Blocks(points.withColumn("blk", F.lit(0).cast("long")), None, block_size)

    kind = dict(points.dtypes)["k"]
    long = lambda c: F.lit(c).cast("long")
    root = sizes.select("k", long(0).alias("node"), long(None).alias("parent"), "n", F.lit(None).cast("array<double>").alias("center"),
                        F.lit(math.pi).alias("radius"), (F.col("n") <= block_size).alias("leaf"), F.lit(1).alias("parts"))
    nodes = [_stored(root, "tree-nodes")]
    placed = [points.join(nodes[0].filter("leaf").select("k", "node", "parts"), "k").select("k", "id", "v", "node", "parts")]
    active = points.join(nodes[0].filter("NOT leaf").select("k", "node", "n"), "k").select("k", "id", "v", "node", "n")
    for level in range(LEVELS):
        drawn = F.row_number().over(Window.partitionBy("k", "node").orderBy(F.xxhash64("id", F.lit(level)), "id"))
        sample = active.drop("n").withColumn("_r", drawn).filter(F.col("_r") <= SAMPLE)
        pivots = _stored(sample.groupBy("k", "node").applyInArrow(_pivots, f"k {kind}, node long, c int, center array<double>"), "tree-pivots")
        tasks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
        dealt = active.withColumn("_s", F.pmod(F.xxhash64("id", F.lit(level)), tasks).cast("int")).drop("n")
        beside = pivots.join(nodes[-1].filter("NOT leaf").select("k", "node", "n"), ["k", "node"]).select(
            "k", "node", "c", "center", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("_s"))
        assigned = _stored(dealt.groupBy("k", "node", "_s").cogroup(beside.groupBy("k", "node", "_s")).applyInArrow(
            _assign, f"k {kind}, id long, v array<double>, node long, angle double"), "tree-rows")
        above = nodes[-1].filter("NOT leaf").select("k", F.col("node").alias("parent"), F.col("n").alias("_all"))
        child = assigned.groupBy("k", "node").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        child = child.join(pivots.select("k", (F.col("node") * FANOUT + 1 + F.col("c")).alias("node"), "center"), ["k", "node"])
        child = child.withColumn("parent", F.floor((F.col("node") - 1) / F.lit(FANOUT)).cast("long")).join(above, ["k", "parent"])
        done = (F.col("n") <= block_size) | (F.col("n") == F.col("_all")) | F.lit(level + 1 == LEVELS)
        parts = F.least(F.lit(PARTS), F.ceil(F.col("n") / F.lit(block_size))).cast("int")
        nodes.append(_stored(child.select("k", "node", "parent", "n", "center", "radius", done.alias("leaf"),
                                          F.when(done, parts).otherwise(F.lit(1)).alias("parts")), "tree-nodes"))
        rows = assigned.join(nodes[-1].select("k", "node", "n", "leaf", "parts"), ["k", "node"])
        placed.append(rows.filter("leaf").select("k", "id", "v", "node", "parts"))
        active = rows.filter("NOT leaf").select("k", "id", "v", "node", "n")
        if nodes[-1].filter("NOT leaf").limit(1).count() == 0:
            break
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts"))
    rows = _union(placed).select("k", "id", "v", (F.col("node") * PARTS + part).cast("long").alias("blk"))
    return Blocks(_stored(rows, "tree-blocks"), _union(nodes), block_size)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
