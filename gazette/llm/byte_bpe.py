"""Byte-level BPE: encoding by overlapping chunks, decoding by joining token bytes.

Method: a long text is cut into chunks of ``chunk`` code points, each with the
first ``overlap`` code points of its successor. Chunks are dealt over tasks and
pre-tokenised there on their own. A match of the pre-token pattern depends only
on the text from its start on, so as soon as two readings of one text share a
boundary they agree from there on. Each chunk therefore reports its boundaries
in the part that it shares with its neighbours; the first boundary that both
sides have is where they are stitched, and everything between two stitches is
one segment, encoded on its own. A segment normally is one chunk. If a
pre-token is longer than the overlap, the sides share no boundary; these chunks
become one segment and are read again as a whole, so its size is that of the
pre-token and two chunks. The ids of a text are its segments' ids in order.

The last matches of a chunk (within ``LOOK`` code points of its end) are not
used as boundaries, since the pattern may look further than the chunk goes.

Merging (``merges``): the adjacent pair with the lowest rank first, the leftmost
on ties, as rank files define it; the new words of some megabytes of text merge
together. Decoding gathers the bytes of the ids.

Defined results: a null or empty text has no ids and decodes to no bytes; rows
with equal ids are encoded each; an empty table gives an empty result; only the
columns named in ``keep`` are read beside the text, so other names cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.merges import Merges, WordCoder
from gazette.session import ensure_checkpoint_dir, scratch_path, ship_package

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 1 << 16          # code points of a chunk
OVERLAP = 1 << 10        # code points that a chunk shares with its successor
LOOK = 4                 # code points that the pattern may look beyond a match, with room
SLAB = 2_000_000         # characters of the texts that a task encodes together


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


# --------------------------------------------------------------------------- merging
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass(frozen=True)
class Spec:
    """A rank file (found on every machine), a pre-token pattern and the sizes of chunks."""

    ranks: str = DEFAULT_RANKS
    pattern: str | None = None
    chunk: int = CHUNK
    overlap: int = OVERLAP

    def __post_init__(self):
        if not 0 < self.overlap < self.chunk:
            raise ValueError("a chunk must be longer than the overlap")


class Encoder:
    """Pre-tokens and ids of texts."""

    def __init__(self, spec: Spec):
        import regex

        ranks = load_ranks(spec.ranks)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file lacks single bytes: {missing[:5]}")
        self.pattern = regex.compile(spec.pattern or default_pattern())
        self.words = WordCoder(Merges.of_ranks(ranks), ranks)

    def ends(self, text: str) -> np.ndarray:
        return np.fromiter((m.end() for m in self.pattern.finditer(text)), np.int64)

    def texts(self, texts: Sequence[str]) -> list[np.ndarray]:
        return self.words.ids([self.pattern.findall(t) for t in texts])


@lru_cache(maxsize=2)
def encoder(spec: Spec) -> Encoder:
    return Encoder(spec)


# --------------------------------------------------------------------------- chunks
def cut(text: str, spec: Spec) -> Iterator[tuple[int, bool, str]]:
    """``(number, last, text with overlap)`` of every chunk."""
    last = max(0, (len(text) - 1) // spec.chunk)
    for c in range(last + 1):
        yield c, c == last, text[c * spec.chunk:(c + 1) * spec.chunk + (spec.overlap if c < last else 0)]


def boundaries(part: str, number: int, last: bool, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries of a chunk, as positions in its text; and the ones that it shares with the chunk before it and
    after it, as positions in the whole text."""
    ends = encoder(spec).ends(part)
    sure = ends if last else ends[ends <= len(part) - LOOK]
    start = number * spec.chunk
    head = np.r_[0, sure[sure <= spec.overlap]] if number else np.empty(0, np.int64)
    tail = np.empty(0, np.int64) if last else sure[sure >= spec.chunk]
    return ends, head + start, tail + start


def join_parts(parts: Sequence[str], spec: Spec) -> str:
    """Neighbouring chunks as one text: every part without its overlap, but the last."""
    return "".join([p[:spec.chunk] for p in parts[:-1]]) + parts[-1]


def _cut_pass(spec: Spec):
    def run(batches):
        for batch in batches:
            rows = batch.column("_rid").to_pylist()
            for rid, text in zip(rows, batch.column("_text").to_pylist(), strict=True):
                for c, last, part in cut(text, spec):
                    yield pa.RecordBatch.from_pydict({"_rid": [rid], "_c": [c], "_last": [last], "_part": [part]},
                                                     schema=_PART)
    return run


_PART = pa.schema([("_rid", pa.int64()), ("_c", pa.int64()), ("_last", pa.bool_()), ("_part", pa.string())])
_READ = pa.schema([*_PART, ("_ends", pa.list_(pa.int64())), ("_head", pa.list_(pa.int64())), ("_tail", pa.list_(pa.int64()))])
_READ_DDL = "_rid long, _c long, _last boolean, _part string, _ends array<long>, _head array<long>, _tail array<long>"


def _read_pass(spec: Spec):
    def run(batches):
        for batch in batches:
            for rid, c, last, part in zip(*[batch.column(n).to_pylist() for n in _PART.names], strict=True):
                ends, head, tail = boundaries(part, c, last, spec)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in
                                                  zip((rid, c, last, part, ends, head, tail), _READ, strict=True)], schema=_READ)
    return run


def _segment_pass(spec: Spec):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["_c", "_part", "_ends", "_from", "_to"]).to_pylist(), key=lambda r: r["_c"])
        enc = encoder(spec)
        start = rows[0]["_c"] * spec.chunk
        a = rows[0]["_from"] - start
        text = join_parts([r["_part"] for r in rows], spec)
        b = len(text) if rows[0]["_to"] is None else rows[0]["_to"] - start
        if len(rows) == 1:                                   # the chunk's own boundaries hold from its stitch on
            ends = np.asarray(rows[0]["_ends"], np.int64)
            at = [a, *ends[(ends > a) & (ends <= b)].tolist()]
            words = [text[x:y] for x, y in zip(at, at[1:], strict=False)]
        else:
            words = enc.pattern.findall(text[a:]) if rows[0]["_to"] is None else _until(enc, text, a, b)
        return pa.table({"_rid": pa.array([table.column("_rid")[0].as_py()], pa.int64()),
                         "_c": pa.array([rows[0]["_c"]], pa.int64()),
                         "_ids": pa.array(enc.words.ids([words]), pa.list_(pa.int32()))})
    return run


def _until(enc: Encoder, text: str, a: int, b: int) -> list[str]:
    """Pre-tokens from ``a`` to the stitch at ``b``, read with the text beyond it in view."""
    out = []
    for m in enc.pattern.finditer(text, a):
        if m.start() >= b:
            break
        out.append(m.group())
    return out


# --------------------------------------------------------------------------- encode
def encode(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", spec: Spec = Spec()) -> DataFrame:
    """The columns ``keep`` and ``ids``: the token ids of every row's whole text."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
                     F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kept = [rows.schema[n] for n in names]
    short = _encode_whole(rows.filter(F.length("_text") <= spec.chunk), kept, spec)

    # the long texts: written once under numbers that stay, cut, dealt, read, stitched
    path = scratch_path(spark, "bpe-long")
    rows.filter(F.length("_text") > spec.chunk).withColumn("_rid", F.monotonically_increasing_id()).write.parquet(path)
    whole = spark.read.parquet(path)
    parts = whole.select("_rid", "_text").mapInArrow(_cut_pass(spec), "_rid long, _c long, _last boolean, _part string")
    path = scratch_path(spark, "bpe-chunks")
    parts.repartition("_rid", "_c").mapInArrow(_read_pass(spec), _READ_DDL).write.parquet(path)
    read = spark.read.parquet(path)

    by_text = Window.partitionBy("_rid").orderBy("_c")
    met = F.array_min(F.array_intersect("_head", F.lag("_tail").over(by_text)))
    stitch = read.select("_rid", "_c", F.when(F.col("_c") == 0, F.lit(0)).otherwise(met).cast("long").alias("_from"))
    stitch = stitch.withColumn("_seg", F.count("_from").over(by_text))
    segment = stitch.groupBy("_rid", "_seg").agg(F.max("_from").alias("_from"))
    segment = segment.withColumn("_to", F.lead("_from").over(Window.partitionBy("_rid").orderBy("_seg")))
    ids = (read.join(stitch.select("_rid", "_c", "_seg"), ["_rid", "_c"]).join(segment, ["_rid", "_seg"])
           .groupBy("_rid", "_seg").applyInArrow(_segment_pass(spec), "_rid long, _c long, _ids array<int>"))
    ids = ids.groupBy("_rid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_ids"))),
                                                        lambda s: s["_ids"])).alias("ids"))
    long = whole.drop("_text").join(ids, "_rid").select(*names, "ids")
    return short.unionByName(long).select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "ids")


def slabs(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of together at most ``most`` (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _encode_whole(rows: DataFrame, kept: list[T.StructField], spec: Spec) -> DataFrame:
    def run(batches):
        enc = encoder(spec)
        for batch in batches:
            sizes = pc.utf8_length(batch.column("_text")).to_pylist()
            for lo, hi in slabs(sizes, SLAB):
                part = batch.slice(lo, hi - lo)
                ids = enc.texts(part.column("_text").to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(i) for i in ids], out=offsets[1:])
                flat = np.concatenate(ids)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], column], names=[*[f.name for f in kept], "ids"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


# --------------------------------------------------------------------------- decode
class ByteTable:
    """Bytes of all tokens in one array, for gathering."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens, default=-1) + 1
        self.length = np.zeros(size, np.int64)
        for i, b in tokens.items():
            self.length[i] = len(b)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self.known = np.zeros(size, bool)
        self.known[list(tokens)] = True

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes of all ids in a row, length of each id)``."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.length[ids]
        first = np.cumsum(n) - n
        return self.data[np.repeat(self.start[ids] - first, n) + np.arange(int(n.sum()))], n


@lru_cache(maxsize=2)
def byte_table(path: str) -> ByteTable:
    return ByteTable({r: b for b, r in load_ranks(path).items()})


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", spec: Spec = Spec()) -> DataFrame:
    """``df`` with a binary column: the bytes of the ids of each row (none for null or no ids).

    An id that the rank file lacks is an error. Bytes need not be whole characters: any list of ids decodes.
    """
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches):
        table = byte_table(spec.ranks)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_pylist()
            for lo, hi in slabs(counts, SLAB):
                part = batch.slice(lo, hi - lo)
                out, at, flat = [], 0, np.asarray(part.column(ids_col).flatten())
                for n in counts[lo:hi]:                     # a row at a time: the index is as long as its bytes
                    out.append(table.gather(flat[at:at + n])[0].tobytes())
                    at += n
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def digest_columns(decoded: DataFrame, ids_col: str = "ids", raw_col: str = "decoded") -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` in place of the ids and bytes."""
    rest = [c for c in decoded.columns if c not in (ids_col, raw_col)]
    text = F.array_join(F.col(ids_col).cast("array<string>"), " ")
    return decoded.select(*rest, F.size(ids_col).cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col(raw_col), 256).alias("decoded_sha256"))
