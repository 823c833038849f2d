"""Clustering per category (G1-G7): neighbour pairs, DBSCAN, cluster table, keywords, top clusters.

Scale notes
-----------
* Neighbour search is exact. Categories beyond ``block_size`` rows are split by a
  metric tree (``metric_tree``); by the triangle inequality on angles, two of
  its balls that are further apart than eps allows hold no pair, and no tile
  below them is laid. Every other pair of leaves is one matrix product in
  ``applyInArrow``, so a task holds two blocks whatever the category's size.
* DBSCAN needs no pair table: its tasks return degrees (one number per row) and a
  spanning forest of their core rows (at most one edge per row), joined by
  connected components; border rows bring the roots they touch.
* A task of DBSCAN holds two panels, runs of blocks that lie beside each other in
  the tree, and walks the tiles between them. So a row is copied once for each
  panel of its key (``PANELS``, more only where a panel would exceed
  ``PANEL_BYTES``), not once for each tile of its block.
* The texts of articles are shuffled once, by id, and stored once: blocks and
  labels are made of the vectors alone.
* Rows without a vector are noise, rows without a category are ``unknown``.
* Keywords are counted with a grouped aggregation per (cluster, word), then a
  top-k window (planned as a WindowGroupLimit), never from collected text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette import dims
from gazette.functions.text import WHITESPACE_RUN, py_len_sum
from gazette.operators import metric_tree
from gazette.operators.components import connected_components
from gazette.session import ensure_checkpoint_dir, scratch_path, ship_package

DEFAULT_BLOCK = 2048
PANELS = 8                   # panels of a key, as long as none exceeds PANEL_BYTES
PANEL_BYTES = 1 << 24        # vectors of a panel, about


# --------------------------------------------------------------------------- tiles
def _points(df: DataFrame, key: str, id_col: str, vec_col: str) -> DataFrame:
    return df.filter(F.col(vec_col).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def _blocks(df: DataFrame, key: str, id_col: str, vec_col: str, block_size: int) -> metric_tree.Blocks:
    """The rows with a vector in blocks of a metric tree; they are read several times, so they are kept first."""
    ensure_checkpoint_dir(df.sparkSession)
    return metric_tree.build(_points(df, key, id_col, vec_col).checkpoint(), block_size)


def _tile_rows(rows: DataFrame, tiles: DataFrame | None) -> DataFrame:
    """The rows of every tile: ``k, lo, hi, side`` and the row. Without ``tiles`` every key is one block and one tile."""
    keep = [c for c in rows.columns if c != "blk"]
    if tiles is None:
        return rows.select(*keep, F.col("blk").alias("lo"), F.col("blk").alias("hi"), F.lit(0).alias("side"))
    lo = rows.withColumnRenamed("blk", "lo").join(tiles, ["k", "lo"]).select(*keep, "lo", "hi", F.lit(0).alias("side"))
    hi = rows.withColumnRenamed("blk", "hi").join(tiles.filter("lo <> hi"), ["k", "hi"]).select(
        *keep, "lo", "hi", F.lit(1).alias("side"))
    return lo.unionByName(hi)


def tile_counts(df: DataFrame, eps: float, key: str = "category", id_col: str = "pos", vec_col: str = "vec",
                block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Per key the number of blocks, of tiles of blocks that may hold a pair, and of all pairs of blocks.

    For choosing eps and the block size of a table: the work is proportional to the tiles. ``neighbor_pairs`` and
    ``dbscan_labels`` lay blocks smaller than ``metric_tree.BUNDLE`` rows in bundles of them.
    """
    ship_package(df.sparkSession)
    blocks = _blocks(df, key, id_col, vec_col, block_size)
    tiles = blocks.tiles(float(eps))
    n = blocks.rows.groupBy("k").agg(F.countDistinct("blk").alias("blocks"))
    laid = n.select("k", F.lit(1).cast("long").alias("tiles")) if tiles is None else tiles.groupBy("k").agg(F.count("*").alias("tiles"))
    return n.join(laid, "k").select(F.col("k").alias(key), "blocks", "tiles",
                                    F.expr("blocks * (blocks + 1) div 2").alias("all_pairs"))


class _Tile:
    """Unit vectors of the two blocks of a tile and which rows lie within eps of each other."""

    def __init__(self, table: pa.Table, eps: float):
        side = table.column("side").to_numpy()
        ids = table.column("id").to_numpy()
        m = metric_tree.unit(table, "v")
        self.key = table.column("k")[0]
        self.a = np.flatnonzero(side == 0)
        self.same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        self.b = self.a if self.same else np.flatnonzero(side == 1)
        self.ids = ids
        self.dist = np.clip(1.0 - m[self.a] @ m[self.b].T, 0.0, 2.0)
        self.near = self.dist <= eps
        if self.same:
            np.fill_diagonal(self.near, False)

    def table(self, names, *cols) -> pa.Table:
        n = len(cols[0])
        return pa.Table.from_arrays([pa.array([self.key.as_py()] * n, self.key.type), *[pa.array(c) for c in cols]], ["k", *names])


# --------------------------------------------------------------------------- G1
def neighbor_pairs(df: DataFrame, eps: float, key: str = "category", id_col: str = "pos", vec_col: str = "vec",
                   block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Pairs ``(key, a, b, dist)`` with ``a < b`` in the same ``key`` and cosine distance <= eps.

    Distances follow the usual definition for precomputed cosine distances:
    1 - cos of unit vectors, clipped to [0, 2]; a zero vector has distance 1 to
    every other vector. Rows without a vector or a key have no pairs.
    """
    ship_package(df.sparkSession)
    limit = float(eps)

    def tile(table: pa.Table) -> pa.Table:
        t = _Tile(table, limit)
        i, j = np.nonzero(np.triu(t.near) if t.same else t.near)
        a, b = t.ids[t.a[i]], t.ids[t.b[j]]
        return t.table(["a", "b", "dist"], np.minimum(a, b), np.maximum(a, b), t.dist[i, j])

    blocks = _blocks(df, key, id_col, vec_col, block_size).bundles()
    rows = _tile_rows(blocks.rows, blocks.tiles(limit))
    kind = dict(rows.dtypes)["k"]
    pairs = rows.groupBy("k", "lo", "hi").applyInArrow(tile, f"k {kind}, a long, b long, dist double")
    return pairs.select(F.col("k").alias(key), "a", "b", "dist")


# --------------------------------------------------------------------------- G2
def _panels(blocks: metric_tree.Blocks, tiles: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """The pairs of panels each block belongs to (``k, blk, to``), and their tiles (``k, p, q, lo, hi``).

    Blocks follow each other by number, so children of a node share a panel. Without ``tiles`` every key is one block.
    """
    if tiles is None:
        return None, None
    width = max(1, blocks.nodes.agg(F.max(F.size("center"))).first()[0] or 1)
    most = max(1, PANEL_BYTES // (8 * width))
    in_key = Window.partitionBy("k")
    before = F.sum("n").over(in_key.orderBy("blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    wide = F.least(F.greatest(F.lit(metric_tree.BUNDLE), F.ceil(F.sum("n").over(in_key) / F.lit(PANELS))), F.lit(most))
    place = blocks.rows.groupBy("k", "blk").agg(F.count("*").alias("n")).select("k", "blk", F.floor(before / wide).alias("panel")).checkpoint()
    side = lambda blk, panel: place.select("k", F.col("blk").alias(blk), F.col("panel").alias(panel))
    pairs = tiles.join(side("lo", "p"), ["k", "lo"]).join(side("hi", "q"), ["k", "hi"]).select("k", "p", "q", "lo", "hi").checkpoint()
    laid = pairs.select("k", F.struct("p", "q").alias("to")).distinct()
    to = laid.select("k", F.explode(F.array_distinct(F.array("to.p", "to.q"))).alias("panel"), "to").groupBy("k", "panel").agg(
        F.collect_list("to").alias("to"))
    return place.join(to, ["k", "panel"]).select("k", "blk", "to").checkpoint(), pairs


def _in_pairs(rows: DataFrame, place: DataFrame | None) -> DataFrame:
    """The rows of every pair of panels: the row and ``p, q``."""
    if place is None:
        return rows.withColumns({"p": F.lit(0), "q": F.lit(0)})
    dealt = rows.join(place, ["k", "blk"]).withColumn("to", F.explode("to"))
    return dealt.select(*rows.columns, F.col("to.p").alias("p"), F.col("to.q").alias("q"))


class _Panels:
    """Unit vectors of two panels, ordered by id, and which rows of two of their blocks lie within eps of each other."""

    def __init__(self, table: pa.Table, pairs: pa.Table | None, eps: float):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.eps = ids[order], eps
        self.unit = metric_tree.unit(table, "v")[order]
        self.core = (table.column("core").to_numpy(zero_copy_only=False).astype(bool)[order] if "core" in table.schema.names
                     else np.ones(len(ids), bool))
        blk = table.column("blk").to_numpy()[order]
        by_block = np.argsort(blk, kind="stable")
        numbers, start = np.unique(blk[by_block], return_index=True)
        self.rows = dict(zip(numbers.tolist(), np.split(by_block, start[1:]), strict=True)) if len(ids) else {}
        self.pairs = [(n, n) for n in self.rows] if pairs is None else sorted(
            zip(pairs.column("lo").to_pylist(), pairs.column("hi").to_pylist(), strict=True))

    def near(self, lo: int, hi: int) -> np.ndarray:
        out = np.clip(1.0 - self.unit[self.rows[lo]] @ self.unit[self.rows[hi]].T, 0.0, 2.0) <= self.eps
        if lo == hi:
            np.fill_diagonal(out, False)
        return out


def _in_panels(rows: DataFrame, pairs: DataFrame | None, eps: float, names: list[str], made, schema: str) -> DataFrame:
    """``made`` (columns from ``_Panels``) of every pair of panels, after the key ``k``."""
    schema = f"k {dict(rows.dtypes)['k']}, {schema}"

    def one(table: pa.Table, tiles: pa.Table | None = None) -> pa.Table:
        cols = made(_Panels(table, tiles, eps))
        key = pa.array([table.column("k")[0].as_py()] * len(cols[0]) if table.num_rows else [], table.schema.field("k").type)
        return pa.Table.from_arrays([key, *[pa.array(c) for c in cols]], ["k", *names])

    grouped = rows.groupBy("k", "p", "q")
    if pairs is None:
        return grouped.applyInArrow(lambda table: one(table), schema)
    return grouped.cogroup(pairs.groupBy("k", "p", "q")).applyInArrow(lambda table, tiles: one(table, tiles), schema)


def _degrees(rows: DataFrame, pairs: DataFrame | None, eps: float) -> DataFrame:
    """``k, id, deg``: number of other rows within eps."""
    def made(t: _Panels) -> list[np.ndarray]:
        deg = np.zeros(len(t.ids), np.int64)
        for lo, hi in t.pairs:
            near = t.near(lo, hi)
            deg[t.rows[lo]] += near.sum(axis=1)
            if lo != hi:
                deg[t.rows[hi]] += near.sum(axis=0)
        return [t.ids[deg > 0], deg[deg > 0]]

    return _in_panels(rows, pairs, eps, ["id", "deg"], made, "id long, deg long").groupBy("k", "id").agg(F.sum("deg").alias("deg"))


def _forest(rows: DataFrame, pairs: DataFrame | None, eps: float) -> DataFrame:
    """``k, border, a, b``: edges that join the core rows of two panels, and roots that other rows touch."""
    def made(t: _Panels) -> list[np.ndarray]:
        n = len(t.ids)
        label = np.arange(n)                          # the smallest row known to be connected, always one with its own label
        touched = [np.empty((0, 2), np.int64)]
        for lo, hi in t.pairs:
            a, b = t.rows[lo], t.rows[hi]
            both = label[np.r_[a, b]]
            if t.core[a].all() and t.core[b].all() and (both == both[0]).all():
                continue                              # all connected, and no border rows
            near = t.near(lo, hi)
            link = near & t.core[a][:, None] & t.core[b][None, :]
            while True:
                was_a, was_b = label[a], label[b]
                new_a = np.minimum(was_a, np.where(link, was_b[None, :], n).min(axis=1, initial=n))
                new_b = np.minimum(was_b, np.where(link, was_a[:, None], n).min(axis=0, initial=n))
                if np.array_equal(new_a, was_a) and np.array_equal(new_b, was_b):
                    break
                np.minimum.at(label, was_a, new_a)    # what is connected to the old label follows
                np.minimum.at(label, was_b, new_b)
                while not np.array_equal(label, label[label]):
                    label = label[label]
            for x, y, close in ((a, b, near), *(() if lo == hi else ((b, a, near.T),))):
                i, j = np.nonzero(close & ~t.core[x][:, None] & t.core[y][None, :])
                if len(i):
                    touched.append(np.unique(np.stack([x[i], label[y[j]]], axis=1), axis=0))
        border = np.concatenate(touched)
        border = np.unique(np.stack([border[:, 0], label[border[:, 1]]], axis=1), axis=0)
        moved = np.flatnonzero(label != np.arange(n))
        return [np.r_[np.zeros(len(moved), bool), np.ones(len(border), bool)], np.r_[t.ids[moved], t.ids[border[:, 0]]],
                np.r_[t.ids[label[moved]], t.ids[border[:, 1]]]]

    return _in_panels(rows, pairs, eps, ["border", "a", "b"], made, "border boolean, a long, b long")


ROOT_BUCKET_BITS = 16


def _root_ranks(roots: DataFrame, key: str) -> DataFrame:
    """0-based rank of each distinct root within its key, without one task per key.

    Roots are bucketed by id range (2^16 ids per bucket); bucket sizes are
    prefix-summed per key (one row per bucket) and roots are ranked inside
    their bucket, so no task sorts more than one bucket of roots.
    """
    b = roots.withColumn("bucket", F.shiftright("root", ROOT_BUCKET_BITS))
    sizes = b.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(key, "bucket", (F.sum("n").over(upto) - F.col("n")).alias("offset"))
    inner = b.withColumn("r", F.row_number().over(Window.partitionBy(key, "bucket").orderBy("root")))
    return (inner.join(offsets, [key, "bucket"])
            .select(key, "root", (F.col("offset") + F.col("r") - 1).alias("cluster_id")))


def dbscan_labels(df: DataFrame, eps: float, min_samples: int = 2, key: str = "category", id_col: str = "pos",
                  vec_col: str = "vec", block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """``(key, id, cluster_id, is_core)`` of the rows with a vector; noise has cluster_id -1.

    Core: at least ``min_samples`` rows within eps, itself included. Clusters
    are connected core rows, numbered 0, 1, ... by their smallest id within
    the key. A border row joins the lowest-numbered cluster among its core
    neighbours. Everything is keyed by (key, id): ids may repeat between keys.
    """
    ship_package(df.sparkSession)
    limit = float(eps)
    blocks = _blocks(df, key, id_col, vec_col, block_size).bundles()
    placed = blocks.rows
    place, pairs = _panels(blocks, blocks.tiles(limit))
    points = placed.select("k", "id")
    if min_samples > 2:
        deg = _degrees(_in_pairs(placed, place), pairs, limit)
        placed = (placed.join(deg, ["k", "id"], "left")
                  .withColumn("core", F.coalesce("deg", F.lit(0)) + 1 >= min_samples).drop("deg").checkpoint())
        points = placed.select("k", "id", "core")
    forest = _forest(_in_pairs(placed, place), pairs, limit).checkpoint()
    node = lambda c: F.struct(F.col("k"), F.col(c).alias("id"))
    comp = connected_components(forest.filter("NOT border").select(node("a").alias("a"), node("b").alias("b"))).select(
        F.col("id.k").alias("k"), F.col("id.id").alias("id"), F.col("root.id").alias("root"))
    if min_samples <= 2:                  # with two, every row that has a neighbour is core; with one, every row
        pts = points.join(comp, ["k", "id"], "left").withColumn("core", F.col("root").isNotNull() | F.lit(min_samples < 2))
        pts = pts.withColumn("root", F.when(F.col("core"), F.coalesce("root", "id")))
    else:
        touch = forest.filter("border").select("k", "a", F.col("b").alias("id")).join(comp, ["k", "id"], "left").groupBy(
            "k", F.col("a").alias("id")).agg(F.min(F.coalesce("root", "id")).alias("broot"))
        pts = (points.join(comp, ["k", "id"], "left").join(touch, ["k", "id"], "left")
               .withColumn("root", F.when(F.col("core"), F.coalesce("root", "id")).otherwise(F.col("broot"))))
    ranks = _root_ranks(pts.filter(F.col("root").isNotNull()).select("k", "root").distinct(), "k")
    return pts.join(ranks, ["k", "root"], "left").select(
        F.col("k").alias(key), F.col("id").alias(id_col), F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"),
        F.col("core").alias("is_core"))


# --------------------------------------------------------------------------- G3 + G1 + G2
def cluster_members(df: DataFrame, eps: float = 0.35, min_samples: int = 2, key: str = "category",
                    id_col: str = "pos", vec_col: str = "vec", block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Every input row with ``cluster_id, is_noise, small, cat_first`` added.

    A key with fewer than ``min_samples`` rows is one noise cluster with id 0
    (``small`` = true); otherwise DBSCAN labels, noise = -1. A row without a
    vector is noise; a row without a key belongs to ``unknown``.
    """
    return members_of(clustered(df, eps, min_samples, key, id_col, vec_col, block_size))


def clustered(df: DataFrame, eps: float = 0.35, min_samples: int = 2, key: str = "category", id_col: str = "pos",
              vec_col: str = "vec", block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """The members as a stored table that holds each input row once, with ``times``, how often it is a member.

    A row is one member for every row with a vector that has its key and id, so
    ``times`` is 1 unless these repeat. ``df`` is read twice, first its keys and
    vectors and then all of it, and has to give the same rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.withColumn(key, F.coalesce(F.col(key), F.lit(dims.UNKNOWN_CATEGORY)))
    slim = _kept(df.select(key, id_col, vec_col), "cluster-vectors")
    labels = dbscan_labels(slim, eps, min_samples, key, id_col, vec_col, block_size)
    sizes = slim.groupBy(key).agg(F.count("*").alias("_n"), F.min(id_col).alias("cat_first"))
    # rows of one key and id have one label. They are joined by id alone: a table that was joined by its id before
    # is not shuffled again with its texts
    own = labels.groupBy(key, id_col).agg(F.min("cluster_id").alias("c"), F.count("*").alias("n"))
    own = own.groupBy(id_col).agg(F.collect_list(F.struct(F.col(key).alias("k"), "c", "n")).alias("_labels"))
    rows = (df.join(own, id_col, "left").join(sizes, key)
            .withColumn("_own", F.get(F.filter("_labels", lambda x: x["k"] == F.col(key)), F.lit(0)))
            .withColumn("small", F.col("_n") < min_samples)
            .withColumn("cluster_id", F.when(F.col("small"), F.lit(0).cast("long"))
                        .otherwise(F.coalesce("_own.c", F.lit(-1).cast("long"))))
            .withColumn("is_noise", F.col("small") | (F.col("cluster_id") == -1))
            .withColumn("times", F.coalesce("_own.n", F.lit(1).cast("long"))))
    made = ["cluster_id", "cat_first", "small", "is_noise", "times"]
    rest = [c for c in df.columns if c not in (key, id_col, *made)]
    return _kept(rows.select(key, id_col, *rest, *made), "cluster-members")


def members_of(rows: DataFrame) -> DataFrame:
    """The members of a table of ``clustered``."""
    if rows.filter("times > 1").limit(1).count():
        rows = rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.drop("times")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table: computed once, read by column, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


# --------------------------------------------------------------------------- G5
def cluster_keywords(members: DataFrame, top_k: int = 5, key: str = "category", id_col: str = "pos",
                     stop_words=dims.KEYWORD_STOP_WORDS) -> DataFrame:
    """``(key, cluster_id, keywords)``: most common words, ties by first occurrence; none -> ['news'].

    Words: lower-cased text split on white space, longer than 3 code points,
    letters only, not a stop word.
    """
    all_clusters = members.select(key, "cluster_id").distinct()
    return _with_keywords(all_clusters, members, top_k, key, id_col, stop_words)


def _with_keywords(table: DataFrame, members: DataFrame, top_k: int, key: str, id_col: str, stop_words) -> DataFrame:
    """``table`` (a row per cluster) with the ``keywords`` of each cluster."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    w = (members.select(key, "cluster_id", id_col, F.posexplode(F.split(text, WHITESPACE_RUN)).alias("i", "w"))
         .filter((F.length("w") > 3) & F.col("w").rlike(r"^\p{L}+$")
                 & ~F.col("w").isin(list(stop_words))))
    # first occurrence = smallest (article, word index), with fixed-width buffers (a struct minimum would force a
    # sort-based aggregate). Ids of 31 bits make one number with the index: one aggregation, combined map-side
    lo, hi = members.agg(F.min(id_col), F.max(id_col)).first()
    if isinstance(lo, int) and 0 <= lo and hi < 1 << 31:
        counts = w.groupBy(key, "cluster_id", "w").agg(
            F.count("*").alias("n"), F.min(F.shiftleft(F.col(id_col).cast("long"), 32) + F.col("i")).alias("first"))
    else:
        per_doc = w.groupBy(key, "cluster_id", "w", id_col).agg(F.count("*").alias("n"), F.min("i").alias("i"))
        counts = (per_doc.groupBy(key, "cluster_id", "w")
                  .agg(F.sum("n").alias("n"), F.min(id_col).alias("p"), F.min_by("i", id_col).alias("i"))
                  .withColumn("first", F.struct("p", "i")))
    rank = Window.partitionBy(key, "cluster_id").orderBy(F.desc("n"), F.asc("first"))
    top = counts.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= top_k)
    kw = (top.groupBy(key, "cluster_id")
          .agg(F.array_sort(F.collect_list(F.struct("r", "w"))).alias("_k"))
          .select(key, "cluster_id", F.transform("_k", lambda s: s["w"]).alias("keywords")))
    return (table.join(kw, [key, "cluster_id"], "left")
            .withColumn("keywords", F.coalesce("keywords", F.array(F.lit(dims.KEYWORD_DEFAULT)))))


# --------------------------------------------------------------------------- G4
def clusters(members: DataFrame, top_k: int = 5, key: str = "category", id_col: str = "pos") -> DataFrame:
    """Cluster table: ``key, cluster_id, size, is_noise, main_title, main_source, keywords, cat_first``.

    The main article is the longest (description + title, code points), the
    first one on ties; for a small key it is simply the first article and has
    no source. Members stay in the long ``members`` table; they are not
    collected into the cluster row.
    """
    length = py_len_sum("description", "title")
    agg = (members.groupBy(key, "cluster_id")
           .agg(F.count("*").alias("size"), F.max("is_noise").alias("is_noise"), F.max("small").alias("small"),
                F.min("cat_first").alias("cat_first"),
                F.max_by(F.struct("title", "source"), F.struct(length, -F.col(id_col))).alias("_longest"),
                F.min_by("title", id_col).alias("_first_title")))
    table = agg.select(
        key, "cluster_id", "size", "is_noise",
        F.when(F.col("small"), F.col("_first_title")).otherwise(F.col("_longest.title")).alias("main_title"),
        F.when(F.col("small"), F.lit(None).cast("string")).otherwise(F.col("_longest.source")).alias("main_source"),
        "cat_first")
    # one row per cluster, read again by top-k, digest items and the header: keep it
    return _with_keywords(table, members, top_k, key, id_col, dims.KEYWORD_STOP_WORDS).checkpoint()


def cluster_by_category(df: DataFrame, eps: float = 0.35, min_samples: int = 2, top_k: int = 5,
                        key: str = "category", id_col: str = "pos", vec_col: str = "vec") -> tuple[DataFrame, DataFrame]:
    """G1-G5 together: ``(members, clusters)``."""
    members = cluster_members(df, eps, min_samples, key, id_col, vec_col)
    return members, clusters(members, top_k, key, id_col)


# --------------------------------------------------------------------------- G6
def significant_clusters(table: DataFrame, key: str = "category", min_size: int = 2) -> DataFrame:
    """Per key: number of clusters with at least ``min_size`` articles that are not noise."""
    sig = (F.col("size") >= min_size) & ~F.col("is_noise")
    return table.groupBy(key).agg(F.count_if(sig).alias("significant"))


# --------------------------------------------------------------------------- G7
def top_clusters(table: DataFrame, category: str | None = None, min_size: int = 2, n: int | None = 10,
                 key: str = "category") -> DataFrame:
    """Largest non-noise clusters, ties by category first appearance then cluster id; ``rank`` from 1."""
    out = table.filter((F.col("size") >= min_size) & ~F.col("is_noise"))
    if category is not None:
        out = out.filter(F.col(key) == category)
    order = [F.desc("size"), F.asc("cat_first"), F.asc("cluster_id")]
    out = out.orderBy(*order)
    if n is None:
        return out
    # the ranked set is bounded by n, so one small window task is fine
    return out.limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
