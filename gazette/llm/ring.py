"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` positions. A row's key (``doc_id``) hashes to a cell;
each shard owns ``vnodes`` cells drawn from a hash of (shard, replica). A cell
belongs to the first virtual node at or clockwise after it. Loads are bounded:
no shard takes more than ``ceil((1 + slack) * total / shards)`` bytes, and a
cell that does not fit its shard continues clockwise to the next virtual node
whose shard has room. So sizes are near equal (law ``bytes``) and only the
overflow, a few hundredths of the rows, leaves its home shard.

Scale: one pass over the texts makes slim rows (id, size, crc, cell), which
are checkpointed. Only one total per cell reaches the driver: at most
``CELLS`` rows whatever the input. A cell heavier than ``1 / SPLIT`` of a shard (a
key that repeats in a great part of the rows) is cut into parts by a hash of
the row; each part is a cell of its own with the same home, so it takes what
room there is and goes on clockwise. Slots are numbered per cell (a window over
even groups) plus the cell's offset in its shard, so nothing is ever sorted per
shard.

Defined results: a null text has size 8 and crc 0; a null key is a key like
any other; rows with equal keys share a cell, and a shard unless the cell is
that heavy; ties in a cell are ordered by (key, crc, size). An empty table
gives an empty result. A part that fits nowhere (a row larger than every
shard's room) goes to the least loaded shard.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.session import ensure_checkpoint_dir

CELLS = 1 << 16          # ring positions; also the bound of what the driver sees
VNODES = 256             # virtual nodes of each shard
SLACK = 0.001            # a shard may exceed the mean by this share
SPLIT = 64               # a cell above this part of a shard is split


def ring_points(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of every virtual node; they depend on the shard's number alone."""
    pts = set()
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()
            pts.add((int.from_bytes(h, "big") % cells, int.from_bytes(h[::-1], "big"), s))
    return [(c, s) for c, _, s in sorted(pts)]


def place_cells(totals: dict, shards: int, slack: float = SLACK, vnodes: int = VNODES,
                cells: int = CELLS) -> tuple[dict, dict]:
    """``(cell -> shard, cell -> home shard)`` for the loaded cells: numbers, or (number, part) of split ones.

    Heavy cells are placed first (ties: lower cell), so that light ones fill
    the last gaps; each goes clockwise from its home until a shard has room.
    """
    points = ring_points(shards, vnodes, cells)
    at = [c for c, _ in points]
    cap = math.ceil((1 + slack) * sum(totals.values()) / shards)
    load = [0] * shards
    placed, homes = {}, {}
    for cell, size in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        start = bisect.bisect_left(at, cell[0] if isinstance(cell, tuple) else cell)
        homes[cell] = points[start % len(points)][1]
        seen: set[int] = set()
        target = None
        for k in range(len(points)):
            s = points[(start + k) % len(points)][1]
            if s in seen:
                continue
            seen.add(s)
            if load[s] + size <= cap:
                target = s
                break
            if len(seen) == shards:
                break
        if target is None:
            target = min(range(shards), key=lambda s: (load[s], s))
        load[target] += size
        placed[cell] = target
    return placed, homes


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                    slack: float = SLACK, vnodes: int = VNODES) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard, home_shard`` for every row of ``docs``."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + F.lit(8)).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int").alias("_cell"),
        F.monotonically_increasing_id().alias("_row"),
    ).checkpoint()
    whole = slim.groupBy("_cell").agg(F.sum("size").alias("b")).collect()                    # <= CELLS rows
    room = max(1, sum(r["b"] for r in whole) // (shards * SPLIT))
    parts = {r["_cell"]: -(-r["b"] // room) for r in whole if r["b"] > room}                 # <= shards * SPLIT cells
    n_parts = F.try_element_at(F.create_map(*[F.lit(x) for p in sorted(parts.items()) for x in p]), F.col("_cell")) if parts else F.lit(None)
    slim = slim.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_row"), n_parts.cast("long")), F.lit(0)).cast("int")).drop("_row")
    cells = slim.groupBy("_cell", "_part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()   # <= CELLS + 2 * shards * SPLIT
    totals = {(r["_cell"], r["_part"]): r["b"] for r in cells}
    placed, homes = place_cells(totals, shards, slack, vnodes)
    offset, filled = {}, [0] * shards
    for r in sorted(cells, key=lambda r: (r["_cell"], r["_part"])):
        c = (r["_cell"], r["_part"])
        offset[c] = filled[placed[c]]
        filled[placed[c]] += r["n"]
    table = spark.createDataFrame([(*c, placed[c], homes[c], offset[c]) for c in sorted(placed)],
                                  "_cell int, _part int, shard int, home_shard int, _offset long")
    rank = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy("_id", "text_crc32", "size"))
    # the placement table has at most CELLS + 2 * shards * SPLIT rows: about 2 MB
    return slim.join(F.broadcast(table), ["_cell", "_part"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_offset") + rank - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "home_shard")
