"""N-gram Jaccard self-join by prefix filters under several global token orders.

Two documents link when their sets of word shingles overlap by at least
``7 * |x & y| >= 3 * (|x| + |y|)``, which is Jaccard >= 0.75. For any global
order of shingles, linked sets share a shingle among the first
``|x| // 4 + 1`` of each. Three orders are used: (frequency, hash) and two
hashes with other seeds; all put shingles that occur once first, so a set whose unique
shingles fill its prefix can link with nothing and drops out. A document stays
only if it shares a prefix shingle with another in every order, and a pair is
verified only if it does so in every order.

Flow (all steps are bounded by a slab of at most ``SLAB`` text bytes, a bucket
of hashes, or a row):

1. Shingle hashes of a slab go out as one packed array per hash bucket; equal
   sets of one task go once. The commonest shingles (found on a sample; they
   only choose an order, never a result) stay with their document instead, so
   no bucket holds a hot shingle.
2. Each bucket counts its shingles and sends back those that occur twice or
   more, with their frequency.
3. Each slab puts its documents together again: set size, unique shingles,
   prefixes, and for documents that can still link the shared shingles.
4. Star round: in each prefix group all documents are compared with its most
   central one. That is linear in the group and finds nearly all links.
5. What the stars leave open: two documents of one group in different
   components. Each has an exact overlap i with the centre and at most w
   other shared shingles, so ``|x & y| <= min(i) + min(w)``. Documents of
   equal (size, i, w) are one type; pairs of types that pass this bound are
   expanded into pairs of documents, which are verified exactly.
6. Connected components over the links.

No pair that the filters allow is skipped, so the components are exact. A
document is known by a 64-bit hash of its shingle set.

Slab numbers come from the scan order of a task: like
``monotonically_increasing_id`` they need an input whose partitions are read
again in the same order (a file scan, or a checkpointed frame).

Defined results: null, empty or blank texts have no shingle and are their own
component; a text of one to four words is one shingle; equal sets (so equal
texts) always link; a null id takes the smallest id of its component, if any;
rows with equal ids each get their row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import textops as T
from gazette.operators.components import connected_components
from gazette.session import ensure_checkpoint_dir, scratch_path

SLAB = 4_000_000
SAMPLE_DOCS = 20_000        # expected sample for the list of common shingles
COMMON = 65_536             # bound of that list
ORDERS = 3
REST = np.uint64((1 << 40) - 1)
SEEDS = [np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)]


def pack48(tokens: np.ndarray) -> bytes:
    """48 bits of every token's hash, sorted, six bytes each."""
    short = np.sort(T.mix(tokens) >> np.uint64(16))
    return short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingle hashes."""
    return int(T.mix(np.array([T.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _common_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in b.column("text").to_pylist()]
        sets = [s for _, some in T.slabs(texts, SLAB) for s in T.shingles(some)]
        if not sets:
            continue
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        many = n >= max(3, len(texts) // 1000)
        yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(n[many])], ["token", "n"])


_PACKED = ("slab long, bucket int, rest binary, docs binary, ids array<string>, nodes array<long>, sizes array<int>, "
           "first array<boolean>, common binary, n_common array<int>")


def _pack_pass(shared, buckets: int):
    schema = pa.schema([("slab", pa.int64()), ("bucket", pa.int32()), ("rest", pa.binary()), ("docs", pa.binary()),
                        ("ids", pa.list_(pa.string())), ("nodes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                        ("first", pa.list_(pa.bool_())), ("common", pa.binary()), ("n_common", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value                         # sorted hashes
        seen: set[int] = set()
        slab = T.first_slab(TaskContext.get().partitionId())
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
            for start, end in T.spans(lengths, SLAB):             # only the texts of a slab become Python objects
                for a in range(start, end, 50_000):               # a document's place in a slab has 16 bits
                    part = b.slice(a, min(end - a, 50_000))
                    texts = [t or b"" for t in part.column("text").to_pylist()]
                    yield one(slab, part.column("id").to_pylist(), T.shingles(texts), common, seen)
                    slab += 1

    def one(slab, ids, sets, common, seen):
        nodes, first, held, n_common, tokens, owner = [], [], [], [], [], []
        for k, s in enumerate(sets):
            node = set_key(s)
            new = len(s) > 0 and node not in seen
            nodes.append(node)
            first.append(new)
            n_common.append(0)
            if new:
                seen.add(node)
                at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
                known = common[at] == s if len(common) else np.zeros(len(s), bool)
                held.append(at[known].astype(np.uint32))
                n_common[-1] = int(known.sum())
                tokens.append(s[~known])
                owner.append(np.full(len(tokens[-1]), k, np.uint16))
        rows = [[slab], [slab % buckets], [None], [None], [ids], [nodes], [[len(s) for s in sets]], [first],
                [b"".join(h.tobytes() for h in held)], [n_common]]
        if tokens:
            t, o = np.concatenate(tokens), np.concatenate(owner)
            bucket = ((t >> np.uint64(44)) % np.uint64(buckets)).astype(np.int32)
            rest = t & REST
            order = np.lexsort((rest, bucket))
            bucket, rest, o = bucket[order], rest[order], o[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                r = rest[x:y]
                new = [slab, int(bucket[x]), T.pack40(r), o[x:y].tobytes(), None, None, None, None, None, None]
                for column, value in zip(rows, new, strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


_COUNTED = ("slab long, tokens binary, freq binary, docs binary, ids array<string>, nodes array<long>, sizes array<int>, "
            "first array<boolean>, common binary, n_common array<int>")


def _count_bucket(table: pa.Table) -> pa.Table:
    """Keeps the shingles of one bucket that occur twice or more; slab rows pass through."""
    bucket = np.uint64(table.column("bucket")[0].as_py())
    whole = table.filter(pc.is_valid(table.column("ids")))
    packed = table.filter(pc.is_valid(table.column("rest")))
    own = ["ids", "nodes", "sizes", "first", "common", "n_common"]
    schema = pa.schema([("slab", pa.int64()), ("tokens", pa.binary()), ("freq", pa.binary()), ("docs", pa.binary()),
                        *[table.schema.field(c) for c in own]])
    n = whole.num_rows
    out = [pa.Table.from_arrays([whole.column("slab"), *[pa.nulls(n, pa.binary())] * 3, *[whole.column(c) for c in own]],
                                schema=schema)]
    if packed.num_rows:
        parts = [T.unpack40(x) for x in packed.column("rest").to_pylist()]
        docs = [np.frombuffer(x, np.uint16) for x in packed.column("docs").to_pylist()]
        token = np.concatenate(parts)
        order = np.argsort(token, kind="stable")
        s = token[order]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        count = np.diff(np.r_[start, len(s)])
        freq = np.empty(len(s), np.uint32)
        freq[order] = np.repeat(count, count)
        at, slabs, cols = 0, [], [[], [], []]
        for slab, t, d in zip(packed.column("slab").to_pylist(), parts, docs, strict=True):
            f = freq[at:at + len(t)]
            at += len(t)
            many = f >= 2
            if many.any():
                slabs.append(slab)
                for c, v in zip(cols, (t[many] | bucket << np.uint64(40), f[many], d[many]), strict=True):
                    c.append(v.tobytes())
        m = len(slabs)
        out.append(pa.Table.from_arrays([pa.array(slabs, pa.int64()), *[pa.array(c, pa.binary()) for c in cols],
                                         *[pa.nulls(m, f.type) for f in list(schema)[4:]]], schema=schema))
    return pa.concat_tables(out)


_SETS = ("id string, node long, n int, live boolean, u int, tokens binary, p0 array<long>, p1 array<long>, p2 array<long>")


def order_keys(tokens: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """Sort orders of shared shingles under the global orders."""
    return [np.lexsort((tokens, freq)), *[np.argsort(T.mix(tokens ^ s), kind="stable") for s in SEEDS]]


def _slab_sets(table: pa.Table) -> pa.Table:
    """Documents of one slab with sizes, prefixes and shared shingles."""
    head = table.filter(pc.is_valid(table.column("ids"))).to_pylist()[0]
    rows = table.filter(pc.is_valid(table.column("tokens")))
    token = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()] or [np.empty(0, np.uint64)])
    freq = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("freq").to_pylist()] or [np.empty(0, np.uint32)])
    doc = np.concatenate([np.frombuffer(x, np.uint16) for x in rows.column("docs").to_pylist()] or [np.empty(0, np.uint16)])
    order = np.argsort(doc, kind="stable")
    token, freq, doc = token[order], freq[order].astype(np.int64), doc[order]
    cuts = np.searchsorted(doc, np.arange(len(head["ids"]) + 1))
    common, c = np.frombuffer(head["common"], np.uint32), 0
    out: list[list] = [[] for _ in range(9)]
    for k, (ident, node, n, first, m) in enumerate(zip(head["ids"], head["nodes"], head["sizes"], head["first"],
                                                       head["n_common"], strict=True)):
        own = common[c:c + m].astype(np.uint64)
        c += m
        a, b = cuts[k], cuts[k + 1]
        unique = n - m - int(b - a)
        room = n // 4 + 1 - unique
        row = [ident, node, n, False, None, None, None, None, None]
        if first and room > 0:
            t = np.r_[token[a:b], own | np.uint64(1 << 62)]
            f = np.r_[freq[a:b], own.astype(np.int64) + (1 << 40)]
            prefixes = [t[o[:room]].view(np.int64) for o in order_keys(t, f)]
            row[3:] = [True, unique, pack48(t), *prefixes]
        for column, value in zip(out, row, strict=True):
            column.append(value)
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)],
                                ["id", "node", "n", "live", "u", "tokens", "p0", "p1", "p2"])


VERIFIED = 512               # pairs whose sets a task holds as Python lists


def _verify_pass(filtered: bool):
    """``a, b, i, link``: the exact overlap of each pair. With ``filtered`` only of pairs that share a prefix shingle in
    the later orders too; the others cannot link and are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, VERIFIED):
                b = batch.slice(start, VERIFIED)
                if filtered:
                    sides = [list(zip(*[b.column(f"{s}{o}").to_pylist() for o in range(1, ORDERS)], strict=True)) for s in "ab"]
                    both = [all(not set(p).isdisjoint(q) for p, q in zip(x, y, strict=True)) for x, y in zip(*sides, strict=True)]
                    b = b.filter(pa.array(both, pa.bool_()))
                col = {c: b.column(c).to_pylist() for c in ("ta", "tb", "na", "nb")}
                overlap = [len(np.intersect1d(unpack48(x), unpack48(y), assume_unique=True))
                           for x, y in zip(col["ta"], col["tb"], strict=True)]
                link = [7 * i >= 3 * (m + n) for i, m, n in zip(overlap, col["na"], col["nb"], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(overlap, pa.int32()),
                                                  pa.array(link, pa.bool_())], ["a", "b", "i", "link"])
    return run


def _verify(pairs: DataFrame, sets: DataFrame, filtered: bool = False) -> DataFrame:
    """Overlap and link of pairs (a, b) of nodes of one star; ``filtered``: the prefix filters of the later orders come first."""
    orders = range(1, ORDERS) if filtered else ()
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("tokens").alias(f"t{s}"),
                                 *[F.col(f"p{o}").alias(f"{s}{o}") for o in orders])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(_verify_pass(filtered), "a long, b long, i int, link boolean")


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Steps 1 to 3: one row per document (``_SETS``), written to the shared folder."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows, text_bytes = src.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    least = max(8, rows * share / 500)
    common = (src.sample(share, seed=9).select("text").mapInArrow(_common_pass, "token long, n long")
              .groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
              .orderBy(F.desc("n"), "token").limit(COMMON).collect())           # at most COMMON numbers
    known = np.sort(np.array([r["token"] for r in common], np.int64).view(np.uint64))
    buckets = T.bucket_count(text_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = scratch_path(spark, "jaccard-sets")
    (src.mapInArrow(_pack_pass(spark.sparkContext.broadcast(known), buckets), _PACKED)
     .groupBy("bucket").applyInArrow(_count_bucket, _COUNTED)
     .groupBy("slab").applyInArrow(_slab_sets, _SETS).write.parquet(out))
    return spark.read.parquet(out)


def link_sets(rows: DataFrame) -> DataFrame:
    """Steps 4 to 6: ``(id, root)`` of the linked nodes of ``document_sets``."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    sets = rows.filter("live").dropDuplicates(["node"]).drop("id", "live")
    kept = scratch_path(spark, "jaccard-live")
    prefix = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(f"p{o}").alias("p")) for o in range(ORDERS)]))
    groups = sets.select("node", "n", prefix.alias("x")).select("node", "n", "x.o", F.explode("x.p").alias("token"))
    size = groups.groupBy("o", "token").agg(F.count("*").alias("c")).filter("c > 1")
    shared = groups.join(size, ["o", "token"])
    every = shared.groupBy("node").agg(F.countDistinct("o").alias("k"),
                                       (F.sum(F.when(F.col("o") == 0, F.col("c")).otherwise(0)) / F.first("n")).alias("score"))
    # of the later orders 31 bits of a shingle are kept from here on: a filter that lets a few more pairs pass
    short = lambda c: F.transform(c, lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias(c)
    (sets.select("node", "n", "u", "tokens", "p0", short("p1"), short("p2")).join(every.filter(F.col("k") == ORDERS).select("node", "score"), "node")
     .write.parquet(kept))
    sets = spark.read.parquet(kept)

    first = sets.select("node", "score", F.explode("p0").alias("token"))
    centre = first.groupBy("token").agg(F.max(F.struct("score", "node"))["node"].alias("centre"))
    stars = (first.join(centre, "token").filter(F.col("node") != F.col("centre"))
             .select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    stars = _verify(stars, sets).checkpoint()
    comp = connected_components(stars.filter("link")).checkpoint()

    # what is left: documents of one star in different components
    size = sets.select("node", "n", "u")
    leaves = stars.select(F.col("a").alias("centre"), F.col("b").alias("node"), "i").join(size, "node")
    middles = stars.select(F.col("a").alias("node")).distinct().join(size, "node").select(
        "node", F.col("node").alias("centre"), F.col("n").alias("i"), "n", "u")
    star = (leaves.unionByName(middles).join(comp.withColumnRenamed("id", "node"), "node", "left")
            .select("centre", "node", "n", "i", F.greatest(F.lit(0), F.col("n") - F.col("i") - F.col("u")).alias("w"),
                    F.coalesce("root", "node").alias("root")))
    open_ = star.groupBy("centre").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).filter("_l <> _h").select("centre")
    star = star.join(open_, "centre").checkpoint()
    kinds = star.groupBy("centre", "n", "i", "w").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    x, y = kinds.alias("x"), kinds.alias("y")
    allowed = x.join(y, F.expr("""x.centre = y.centre AND struct(x.n, x.i, x.w) <= struct(y.n, y.i, y.w)
        AND (x.lo <> y.hi OR x.hi <> y.lo) AND 7 * (least(x.i, y.i) + least(x.w, y.w)) >= 3 * (x.n + y.n)""")).select(
        "x.centre", *[F.col(f"{s}.{c}").alias(f"{c}{s}") for s in "xy" for c in ("n", "i", "w")])
    end = lambda s: star.select("centre", *[F.col(c).alias(f"{c}{s}") for c in ("n", "i", "w")],
                                F.col("node").alias(f"node{s}"), F.col("root").alias(f"root{s}"))
    pairs = (allowed.join(end("x"), ["centre", "nx", "ix", "wx"]).join(end("y"), ["centre", "ny", "iy", "wy"])
             .filter("rootx <> rooty").select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b"))
             .distinct())
    more = _verify(pairs, sets, filtered=True).filter("link").select("a", "b").checkpoint()
    if more.isEmpty():
        return comp
    return connected_components(more.unionByName(comp.select(F.col("root").alias("a"), F.col("id").alias("b"))))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]
    rows = document_sets(docs, id_col, text_col)
    comp = link_sets(rows)
    base = (rows.select(F.col("id").cast(kind).alias("_id"), "node", F.col("n").cast("long").alias("n_shingles"))
            .join(comp.select(F.col("id").alias("node"), "root"), "node", "left")
            .select("_id", "n_shingles", F.coalesce("root", "node").alias("root")))
    base = base.checkpoint()
    # kept apart, so that the join below is one of two shuffles and a large component can be split
    least = base.filter("n_shingles > 0").groupBy("root").agg(F.min("_id").alias("_least")).checkpoint()
    return base.join(least, "root", "left").select(
        F.col("_id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("_id")).otherwise(F.col("_least")).alias("component_id"))
