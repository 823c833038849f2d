"""Benchmark decontamination with SimHash windows (DataFrame expressions only).

Words are lower-cased runs of letters and digits; a shingle is five words (all
words of a shorter item). A shingle weighs its number of characters. Similarity
of a window and an item is the weight of shared distinct shingles over the
weight of all.

1. Document shingles are looked up among the item shingles, with their places.
   Pairs of text and item whose shared shingles weigh less than ``SIMILARITY``
   of the item cannot reach it and go. For the others the item-sized windows
   around the shared shingles get the weight they share at most, as the
   difference of two running sums over the places; windows below ``SIMILARITY``
   of the item go as well. Both steps lose nothing.
2. The windows left, each different text once, get a 64-bit weighted SimHash.
   Fingerprints are cut into ``RADIUS + 1`` blocks; two within ``RADIUS`` bits
   agree in one block at least (pigeonhole), so the join of windows and items on
   (number of words, block, value) finds every item within the radius, whichever
   shingles brought the window, and the bit count of the difference decides.
3. Candidates are verified by the exact similarity; the best window of each
   document and item is kept if it reaches ``SIMILARITY``.

At similarity 0.75 two fingerprints differ in 11 bits on average with a
standard deviation of 3; ``tests/llm/test_decontam.py`` measures what a radius of
20 keeps.

Scale: one pass over the texts with a lookup join, one more that reads the
texts with a pair left. The item table and the keys of these texts are broadcast
only up to ``BROADCAST_ROWS`` rows; beyond that Spark shuffles. Equal windows
(copies of a hot passage) are fingerprinted and verified once, and no key gathers
the rows of a hot item.

Defined results: null or wordless items match nothing; null and empty texts
are clean; windows are clipped at the ends of a text; rows with equal ids
count as one document, null ids too; equal similarity keeps the first window;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.session import broadcast_if_small, ensure_checkpoint_dir

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 20
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(array: str, k: int) -> Column:
    """``struct<h, w>`` of each run of ``k`` words of the array column: hash and characters, in order."""
    word = [f"get({array}, i + {j})" for j in range(1, k)]
    weight = " + ".join(f"coalesce(length({x}), 0)" for x in ["w", *word])
    return F.expr(f"slice(transform({array}, (w, i) -> struct(xxhash64({', '.join(['w', *word])}) AS h, {weight} AS w)), "
                  f"1, greatest(size({array}) - {k - 1}, 0))")


def by_length(df: DataFrame, sizes: list[int], make) -> DataFrame:
    """The union of ``make(rows of df with k, k)`` over the shingle lengths (at most ``SHINGLE``)."""
    out = None
    for k in sizes:
        one = make(df.filter(F.col("k") == k) if "k" in df.columns else df, k)
        out = one if out is None else out.unionByName(one)
    return out


def simhash(array: str) -> Column:
    """64-bit weighted SimHash of an ``array<struct<h, w>>`` column."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(
        CASE WHEN aggregate({array}, 0L, (a, x) -> a + CASE WHEN getbit(x.h, b) = 1 THEN x.w ELSE -x.w END) > 0
             THEN 1L ELSE 0L END, b))""")


def blocks(fingerprint: str, radius: int = RADIUS) -> Column:
    """``radius + 1`` bit blocks of a fingerprint as ``array<struct<block, bits>>``."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    part = lambda a, b: F.shiftrightunsigned(F.col(fingerprint), a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*[F.struct(F.lit(i).alias("block"), part(a, b).alias("bits"))
                     for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])


def item_table(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, n`` (words), ``k`` (shingle length), ``sh`` (distinct shingles), ``total`` (their weight) and ``fp`` of
    every item with a word, kept."""
    ensure_checkpoint_dir(benchmark.sparkSession)
    tasks = 1 + min(256, benchmark.count() // 16)             # a small file is one split; its items are costly
    w = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    w = w.repartition(tasks).withColumn("n", F.size("words")).withColumn("k", F.least("n", F.lit(SHINGLE)))
    sh = by_length(w, list(range(1, SHINGLE + 1)), lambda d, k: d.withColumn("sh", F.array_distinct(shingles("words", k)))).drop("words")
    sh = sh.coalesce(tasks).checkpoint()
    return sh.withColumn("total", weight("sh")).withColumn("fp", simhash("sh")).checkpoint()


def weight(array: str | Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x["w"])


def laid_windows(hits: DataFrame, similarity: float) -> DataFrame:
    """``key, n, k, s``: the item-sized windows that may share ``similarity`` of an item's weight with it.

    ``hits``: ``key, item, n, k, total, p, h, w``, a row for each place of an item's shingle in a text. A window that
    starts at ``s`` holds the places ``s`` to ``s + n - k``.
    """
    enough = lambda shared: shared >= F.col("total") * similarity - 1e-6
    own = ["key", "item", "n", "k", "total"]
    pairs = (hits.groupBy(*own, "h").agg(F.max("w").alias("w")).groupBy(*own).agg(F.sum("w").alias("shared"))
             .filter(enough(F.col("shared"))).select("key", "item"))
    live = hits.join(pairs, ["key", "item"], "left_semi").dropDuplicates(["key", "item", "p"])
    order = Window.partitionBy("key", "item").orderBy("p")
    live = live.select(*own, "p", "w", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                       F.lag("p").over(order).alias("last"), F.lead("p").over(order).alias("next")).checkpoint()
    # each start belongs to the first place at or after it, each end to the last place at or before it
    reach = F.col("n") - F.col("k")
    first = F.greatest(F.col("p") - reach, F.coalesce(F.col("last") + 1, F.col("p") - reach))
    starts = live.select(*own, (F.col("upto") - F.col("w")).alias("before"), F.explode(F.sequence(first, F.col("p"))).alias("s"))
    final = F.least(F.col("p") + reach, F.coalesce(F.col("next") - 1, F.col("p") + reach))
    ends = live.select("key", "item", "upto", F.explode(F.sequence(F.col("p"), final)).alias("e"))
    both = starts.withColumn("e", F.col("s") + reach).join(ends, ["key", "item", "e"])
    return both.filter(enough(F.col("upto") - F.col("before"))).select("key", "n", "k", "s").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
               radius: int = RADIUS) -> DataFrame:
    """``id, item, start, n_words, hamming, similarity``: the best window of each leaked item in each document."""
    ensure_checkpoint_dir(docs.sparkSession)
    items = item_table(benchmark, item_col, item_text)
    sizes = sorted(r[0] for r in items.select("k").distinct().collect()) or [SHINGLE]       # at most five numbers
    table = items.select("k", "item", "n", "total", F.explode("sh").alias("x")).select("k", "item", "n", "total", "x.h", "x.w")
    table = broadcast_if_small(table, BROADCAST_ROWS)

    # a text is known by its row's id and its own hash, so that rows with equal ids do not mix
    mark = F.concat(F.when(F.col(id_col).isNull(), "-").otherwise("+"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                    F.lit("/"), F.xxhash64(text_col).cast("string"), F.lit("/"), F.length(text_col).cast("string"))
    text = docs.filter(F.col(text_col).isNotNull()).select(mark.alias("key"), F.col(id_col).alias("doc"), words(F.col(text_col)).alias("words"))
    found = by_length(text, sizes, lambda d, k: d.select("key", F.posexplode(shingles("words", k)).alias("p", "x"), F.lit(k).alias("k"))
                      .select("key", "p", "k", F.col("x.h").alias("h")))
    hits = found.join(table, ["k", "h"]).checkpoint()
    windows = laid_windows(hits, similarity).groupBy("key", "n", "k").agg(F.collect_list("s").alias("starts")).checkpoint()

    # the texts of these windows only
    keys = broadcast_if_small(windows.select("key").distinct(), BROADCAST_ROWS)
    again = docs.filter(F.col(text_col).isNotNull()).select(mark.alias("key"), F.col(id_col).alias("doc"), F.col(text_col).alias("_t")).join(
        keys, "key", "left_semi").dropDuplicates(["key"]).select("key", "doc", words(F.col("_t")).alias("words"))
    own = "slice(words, greatest(s, 0) + 1, greatest(least(s + n, size(words)) - greatest(s, 0), 0))"
    cut = windows.join(again, "key").select("doc", "n", "k", F.explode(F.expr(
        f"transform(starts, s -> struct(greatest(s, 0) AS start, {own} AS words))")).alias("x")).select("doc", "n", "k", "x.*")
    cut = cut.select("doc", "n", "k", "start", F.size("words").alias("n_words"), F.array_join("words", " ").alias("t"))
    name = ["n", F.md5("t").alias("w1"), F.xxhash64("t").alias("w2")]
    cut = cut.select("doc", "start", "n_words", "k", *name, "t")
    places = cut.select("doc", "start", "n_words", "n", "w1", "w2")
    texts = cut.groupBy("n", "k", "w1", "w2").agg(F.min("t").alias("t"))
    shapes = by_length(texts.withColumn("words", F.split("t", " ")), sizes, lambda d, k: d.select(
        "n", "w1", "w2", F.array_distinct(shingles("words", k)).alias("sh"))).checkpoint()
    prints = shapes.withColumn("fp", simhash("sh")).checkpoint()

    # (words, block, bits) agree in one block at least for all fingerprints within the radius
    sides = prints.select("n", "w1", "w2", "fp", F.explode(blocks("fp", radius)).alias("b")).select("n", "w1", "w2", "fp", "b.*")
    index = items.select("n", "item", F.col("fp").alias("fp_i"), F.explode(blocks("fp", radius)).alias("b")).select("n", "item", "fp_i", "b.*")
    near = sides.join(index, ["n", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_i"))))
    near = near.filter(F.col("hamming") <= radius).groupBy("n", "w1", "w2", "item").agg(F.max("hamming").alias("hamming"))
    scored = near.join(prints.drop("fp"), ["n", "w1", "w2"]).join(items.select("item", F.col("sh").alias("sh_i"), "total"), "item")
    scored = scored.withColumn("both", weight(F.array_intersect("sh", "sh_i"))).withColumn("own", weight("sh"))
    scored = scored.withColumn("similarity", F.col("both") / (F.col("own") + F.col("total") - F.col("both"))).filter(F.col("similarity") >= similarity)
    best = places.join(scored.select("n", "w1", "w2", "item", "hamming", "similarity"), ["n", "w1", "w2"]).groupBy("doc", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("first"), "n_words", "hamming")).alias("m"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), (-F.col("m.first")).cast("long").alias("start"),
                       F.col("m.n_words").cast("long").alias("n_words"), F.col("m.hamming").cast("long").alias("hamming"),
                       F.col("m.similarity").alias("similarity"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leaked item."""
    leaks = find_leaks(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_leak")).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["_leak"]), "left_anti")
