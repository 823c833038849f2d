"""Alignment of two tokenizers over the same bytes, with corpus-wide link counts.

Side A is a byte-level BPE (the merges of a ``tokenizers`` JSON file), side B a piece
model with byte fallback (a ``sentencepiece`` file); both read a space and the text.
Byte offsets at which a token of A and a token of B end cut a text into groups;
all A and B tokens of a group are linked.

Method (merge path): the end offsets of A and of B are two sorted lists. Their
merge is divided along diagonals: a binary search on every ``width``-th
diagonal finds how many ends of either side precede it, so all pieces take the
same number of ends, however the two sides are spread. A piece finds the ends
that it holds on both sides (its overlaps) by itself. An end whose A part is
the last of one piece and whose B part is the first of the next is found when
the pieces are stitched, and with it the groups that lie across a piece
boundary. The ends of all texts of a slab lie on one axis, so short texts share
pieces and a long one is divided.

Three passes: ``align`` encodes and groups (written once, as encoding is the
cost), ``link_counts`` counts for each id pair the texts that hold it linked
(counted per task first), ``score`` reads the counts back. The ``COMMON`` most
frequent pairs go to every task, at most that many rows; pairs beyond them are
joined by a shuffle, so the pair table may grow with the corpus.

Defined results: a null or empty text has no tokens, nor has one whose joined
token bytes on either side differ from space + text (a text with U+2581, say).
Repeated rows are rows of their own and count in the pair counts like others.
Groups of many tokens on both sides are linked through their distinct ids with
multiplicities, in blocks. Only the columns in ``keep`` are read beside the text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.byte_bpe import ByteTable, default_pattern, slabs
from gazette.llm.merges import Merges, WordCoder
from gazette.session import ensure_checkpoint_dir, scratch_path, ship_package

WIDTH = 1 << 14          # ends of both sides in one piece of the merge
SLAB = 500_000           # characters of the texts that are aligned together
TOKENS = 1_000_000       # tokens of the texts whose links are laid out together
BLOCK = 1 << 19          # links laid out at a time
BATCH = 1000             # rows of tokens that a task reads at a time
WIDE = 1 << 12           # links of a group from which its distinct ids are paired instead
COMMON = 1 << 18         # pairs whose counts every task gets
MARK = "▁"


@dataclass(frozen=True)
class Pair:
    """The two files, found on every machine."""

    byte_level: str = "/opt/tokenizers/byte_bpe_50k.json"
    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the other bytes, in order, for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both encoders and the bytes of their tokens."""

    def __init__(self, pair: Pair):
        import regex
        import sentencepiece
        import tiktoken

        with open(pair.byte_level, encoding="utf-8") as f:
            file = json.load(f)
        vocab, byte = file["model"]["vocab"], byte_alphabet()
        special = {t["id"] for t in file.get("added_tokens", ())}
        entry = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if i not in special}
        self.a_bytes = ByteTable(entry)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        letter = {b: c for c, b in byte.items()}
        merges = Merges([vocab[letter[b]] for b in range(256)],
                        [(vocab[x], vocab[y], r, vocab[x + y]) for r, (x, y) in enumerate(pairs)], len(vocab))
        self.words = WordCoder(merges)
        self.pattern = regex.compile(default_pattern())     # the split that byte-level files use
        # If every token is what the listed merges make of its own bytes, then two neighbours that spell a token are always
        # the listed pair (what merges inside a token's bytes does not depend on what is beside them). Joining by
        # spelling, as rank files do, is then the same for every text, and a rank encoder may be used, ids being ranks.
        spelt = {b: i for i, b in entry.items()}
        order = [vocab[x + y] for x, y in pairs]
        same = order == sorted(order) and [np.frombuffer(x, np.int32).tolist() for x in merges.encode(list(spelt))] == [[i] for i in spelt.values()]
        self.ranks = tiktoken.Encoding("side-a", pat_str=default_pattern(), mergeable_ranks=spelt, special_tokens={}) if same else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=pair.pieces)
        piece = {}
        for i in range(self.b.get_piece_size()):
            text = self.b.id_to_piece(i)
            piece[i] = bytes([int(text[3:5], 16)]) if self.b.is_byte(i) else text.replace(MARK, " ").encode()
        self.b_bytes = ByteTable(piece)
        self.n_a, self.n_b = len(self.a_bytes.known), len(self.b_bytes.known)

    def encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each text in a row, and the number of each; strings of special tokens are plain text."""
        if self.ranks:
            return _flat([np.array(self.ranks.encode_ordinary(" " + t), np.int32) for t in texts])
        return _flat(self.words.ids([self.pattern.findall(" " + t) for t in texts]))

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([np.array(x, np.int32) for x in self.b.encode(texts, num_threads=1)] if texts else [])


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.int32), *parts]), np.array([len(p) for p in parts], np.int64)


@lru_cache(maxsize=2)
def sides(pair: Pair) -> Sides:
    return Sides(pair)


# --------------------------------------------------------------------------- merge path
def diagonals(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(i, j)``: how many of ``a`` and of ``b`` are among the first ``d`` of their merge (``a`` first on ties), for
    every ``width``-th ``d`` and the end. One binary search per diagonal, all at once."""
    total = len(a) + len(b)
    d = np.r_[np.arange(0, total, width), total]
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        m = mid[open_]
        before = a[m] <= b[d[open_] - m - 1]
        lo[open_] = np.where(before, m + 1, lo[open_])
        hi[open_] = np.where(before, hi[open_], m)
    return lo, d - lo


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (both strictly increasing) of the ends that both hold."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(b, a)
    i = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return i, at[i]


def common_ends(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of all shared ends, from the pieces of the merge path and their stitches, in order."""
    at_a, at_b = diagonals(a, b, width)
    found = []
    for i, j, k, m in zip(at_a, at_b, at_a[1:], at_b[1:], strict=False):
        if i and j < len(b) and a[i - 1] == b[j]:            # the stitch to the piece before
            found.append((np.array([i - 1]), np.array([j])))
        x, y = overlaps(a[i:k], b[j:m])
        found.append((x + i, y + j))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# --------------------------------------------------------------------------- align
def _spells(table: ByteTable, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which texts are, byte by byte, the tokens they were encoded to?"""
    data, size = table.gather(ids)
    upto = np.r_[0, np.cumsum(size)]
    at = np.r_[0, np.cumsum(counts)]
    length = upto[at[1:]] - upto[at[:-1]]
    want = np.array([len(r) for r in raw], np.int64)
    out = length == want
    if out.all():                                          # the usual case: one comparison of all bytes
        wrong = np.flatnonzero(data != np.frombuffer(b"".join(raw), np.uint8))
        out[np.searchsorted(np.cumsum(want), wrong, "right")] = False
    else:
        for i in np.flatnonzero(out).tolist():
            out[i] = data[upto[at[i]]:upto[at[i + 1]]].tobytes() == raw[i]
    return out


def align_texts(texts: list[str], both: Sides, width: int = WIDTH) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """A ids, B ids, A tokens of each group, B tokens of each group: of all texts in a row, with the number of each text
    (0 for a text without tokens)."""
    full = [t for t in texts if t]
    raw = [b" " + t.encode() for t in full]
    (a, n_a), (b, n_b) = both.encode_a(full), both.encode_b(full)
    good = _spells(both.a_bytes, a, n_a, raw) & _spells(both.b_bytes, b, n_b, raw)
    a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
    n_a, n_b = n_a * good, n_b * good
    x, y = common_ends(np.cumsum(both.a_bytes.length[a]), np.cumsum(both.b_bytes.length[b]), width)
    # every text ends in a shared end, so no group lies across two texts
    n_groups = np.diff(np.searchsorted(x, np.cumsum(n_a) - 1, "right"), prepend=0)
    has = np.array([bool(t) for t in texts], bool)

    def of_all(n: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        out[has] = n
        return out

    return ((a, of_all(n_a)), (b, of_all(n_b)), (np.diff(x, prepend=-1), of_all(n_groups)), (np.diff(y, prepend=-1), of_all(n_groups)))


_ARRAYS = ("a_ids", "b_ids", "a_sizes", "b_sizes")


def align(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", pair: Pair = Pair(),
          width: int = WIDTH) -> DataFrame:
    """The columns ``keep`` and ``a_ids, b_ids`` (the tokens) and ``a_sizes, b_sizes`` (tokens of every group), each
    packed as 32-bit numbers in a binary column; ``unpack`` makes them arrays."""
    ship_package(df.sparkSession)
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text_"))
    kept = [f for f in rows.schema.fields if f.name != "_text_"]
    schema = T.StructType([*kept, *[T.StructField(n, T.BinaryType()) for n in _ARRAYS]])

    def run(batches):
        both = sides(pair)
        for batch in batches:
            for lo, hi in slabs(pc.utf8_length(batch.column("_text_")).to_pylist(), SLAB):
                part = batch.slice(lo, hi - lo)
                packed = [_packed(*x) for x in align_texts(part.column("_text_").to_pylist(), both, width)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *packed], names=schema.names)

    return rows.mapInArrow(run, schema)


def _packed(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = (4 * np.r_[0, np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(np.int32))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column in a row, and the number of each row."""
    return (np.frombuffer(b"".join(column.to_pylist()), np.int32),
            np.asarray(pc.binary_length(column), np.int64) // 4)


def unpack(aligned: DataFrame) -> DataFrame:
    """``align``'s result with arrays of integers."""
    rest = [f for f in aligned.schema.fields if f.name not in _ARRAYS]
    schema = T.StructType([*rest, *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in _ARRAYS]])

    def run(batches):
        for batch in batches:
            lists = []
            for n in _ARRAYS:
                flat, counts = _numbers(batch.column(n))
                lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], *lists], names=schema.names)

    return aligned.mapInArrow(run, schema)


# --------------------------------------------------------------------------- links
@dataclass
class _Slab:
    """The aligned texts of a batch as flat arrays."""

    a: np.ndarray
    b: np.ndarray
    p: np.ndarray              # tokens of A, of B in each group
    q: np.ndarray
    doc: np.ndarray            # text of each group
    n_a: np.ndarray            # per text
    n_b: np.ndarray
    n_groups: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Slab:
        (a, n_a), (b, n_b), (p, n_groups), (q, _) = [_numbers(batch.column(n)) for n in _ARRAYS]
        doc = np.repeat(np.arange(batch.num_rows), n_groups)
        return cls(*[x.astype(np.int64) for x in (a, b, p, q)], doc, n_a, n_b, n_groups)


def _pairs_of(first_a: np.ndarray, p: np.ndarray, first_b: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of A and B, and the group, of every link of the given groups."""
    n = p * q
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return first_a[group] + k // q[group], first_b[group] + k % q[group], group


def link_keys(s: _Slab, n_b: int, radix: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``text * radix + a * n_b + b`` of all links, and how many links have it."""
    keys, counts = [], []

    def add(key: np.ndarray, weight: np.ndarray | None = None) -> None:
        u, inverse = np.unique(key, return_inverse=True)
        c = np.zeros(len(u), np.int64)
        np.add.at(c, inverse, 1 if weight is None else weight)
        keys.append(u)
        counts.append(c)

    first_a, first_b = np.cumsum(s.p) - s.p, np.cumsum(s.q) - s.q
    links = s.p * s.q
    plain = np.flatnonzero(links <= WIDE)
    edge = np.r_[0, np.cumsum(links[plain])]
    at = 0
    while at < len(plain):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + BLOCK, "right")) - 1)
        g = plain[at:to]
        i, j, group = _pairs_of(first_a[g], s.p[g], first_b[g], s.q[g])
        add(s.doc[g][group] * radix + s.a[i] * n_b + s.b[j])
        at = to
    for g in np.flatnonzero(links > WIDE):
        x, nx = np.unique(s.a[first_a[g]:first_a[g] + s.p[g]], return_counts=True)
        y, ny = np.unique(s.b[first_b[g]:first_b[g] + s.q[g]], return_counts=True)
        step = max(1, BLOCK // len(y))
        for lo in range(0, len(x), step):
            add((s.doc[g] * radix + x[lo:lo + step, None] * n_b + y).ravel(), (nx[lo:lo + step, None] * ny).ravel())
    if len(keys) == 1:
        return keys[0], counts[0]
    return merge_counts(keys, counts)


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, keys sorted."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _slabs_of(batch: pa.RecordBatch, radix: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with together some ``TOKENS`` tokens (one row at least) and keys within 63 bits."""
    size = np.asarray(pc.add(pc.binary_length(batch.column("a_ids")), pc.binary_length(batch.column("b_ids"))), np.int64) // 4
    most = max(1, (1 << 62) // radix)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and (total + n > TOKENS or i - start >= most):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def link_counts(aligned: DataFrame, pair: Pair = Pair(), hold: int = 1 << 21) -> DataFrame:
    """``a, b, n``: how many rows hold the id pair linked. A task adds up at most about ``hold`` pairs before it emits."""
    ship_package(aligned.sparkSession)

    def run(batches):
        both = sides(pair)
        radix = both.n_a * both.n_b
        keys, counts, held = [], [], 0

        def emit(k, c):
            for lo in range(0, len(k), 1 << 16):
                x = k[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x // both.n_b, pa.int32()), pa.array(x % both.n_b, pa.int32()),
                                                  pa.array(c[lo:lo + (1 << 16)], pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for part in _slabs_of(batch, radix):
                k = np.sort(link_keys(_Slab.of(part), both.n_b, radix)[0] % radix)
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
                keys.append(k[first])
                counts.append(np.diff(np.r_[first, len(k)]))
                held += len(first)
                if held > hold:
                    k, c = merge_counts(keys, counts)
                    if len(k) > hold // 2:
                        yield from emit(k, c)
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [k], [c], len(k)
        yield from emit(*merge_counts(keys, counts))

    out = aligned.select(*_ARRAYS).mapInArrow(run, "a int, b int, n long")
    return out.groupBy("a", "b").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------------------- score
def decimals(size: int) -> ByteTable:
    """Entry ``4 * id + mark``: the id in decimal and ``,``, ``|``, ``;`` or nothing."""
    return ByteTable({4 * i + k: str(i).encode() + m for i in range(size) for k, m in enumerate((b",", b"|", b";", b""))})


def group_digests(s: _Slab, words: ByteTable) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of every text ('' without tokens)."""
    end_p, end_q = np.cumsum(s.p), np.cumsum(s.q)
    place_a = np.arange(len(s.a)) + np.repeat(end_q - s.q, s.p)
    place_b = np.arange(len(s.b)) + np.repeat(end_p, s.q)
    mark_a, mark_b = np.zeros(len(s.a), np.int64), np.zeros(len(s.b), np.int64)
    mark_a[end_p - 1] = 1
    last = np.r_[s.doc[1:] != s.doc[:-1], np.ones(min(1, len(s.doc)), bool)]
    mark_b[end_q - 1] = np.where(last, 3, 2)
    line = np.empty(len(s.a) + len(s.b), np.int64)
    line[place_a], line[place_b] = s.a * 4 + mark_a, s.b * 4 + mark_b
    data, size = words.gather(line)
    raw = data.tobytes()
    at = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(s.n_a + s.n_b)]].tolist()
    return [hashlib.sha256(raw[x:y]).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False)]


_SCORED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def score(aligned: DataFrame, counts: DataFrame, pair: Pair = Pair(), common: int = COMMON) -> DataFrame:
    """The other columns of ``aligned`` and, per row, ``n_a, n_b, n_groups, n_links``, ``n_best`` (links whose count is
    the highest of their A id), ``count_sum`` (counts over links) and ``groups_sha256``.

    Both frames are read several times: pass stored or checkpointed ones.
    """
    spark = aligned.sparkSession
    sc = spark.sparkContext
    ship_package(spark)
    top = counts.groupBy("a").agg(F.max("n").alias("_top"))                 # at most one row per id of A
    pairs = counts.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("_top")).alias("best"))
    hot = pairs.orderBy(F.desc("n"), "a", "b").limit(common).toArrow()      # at most `common` rows
    whole = hot.num_rows < common
    shared = sc.broadcast([np.asarray(hot.column(c)) for c in ("a", "b", "n", "best")])
    kept = [f for f in aligned.schema.fields if f.name not in _ARRAYS]
    rare = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
                                     T.StructField("m", T.LongType())]))
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in _SCORED],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("_rare", rare)])

    def run(batches):
        both = sides(pair)
        radix = both.n_a * both.n_b
        a, b, n, best = shared.value
        key = a.astype(np.int64) * both.n_b + b
        order = np.argsort(key)
        key, n, best = key[order], n[order], best[order].astype(np.int64)
        words = decimals(max(both.n_a, both.n_b))
        for batch in batches:
            for part in _slabs_of(batch, radix):
                s = _Slab.of(part)
                rows = part.num_rows
                k, m = link_keys(s, both.n_b, radix)
                doc, k = k // radix, k % radix
                at = np.minimum(np.searchsorted(key, k), max(0, len(key) - 1))
                hit = key[at] == k if len(key) else np.zeros(len(k), bool)
                sums = np.zeros((3, rows), np.int64)
                np.add.at(sums[0], doc, m)
                np.add.at(sums[1], doc[hit], m[hit] * best[at[hit]])
                np.add.at(sums[2], doc[hit], m[hit] * n[at[hit]])
                miss = ~hit
                offsets = np.r_[0, np.cumsum(np.bincount(doc[miss], minlength=rows))].astype(np.int32)
                left = pa.StructArray.from_arrays([pa.array(k[miss] // both.n_b, pa.int32()), pa.array(k[miss] % both.n_b, pa.int32()),
                                                   pa.array(m[miss], pa.int64())], ["a", "b", "m"])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f.name) for f in kept], *[pa.array(x, pa.int64()) for x in (s.n_a, s.n_b, s.n_groups, *sums)],
                     pa.array(group_digests(s, words), pa.string()), pa.ListArray.from_arrays(pa.array(offsets), left)],
                    names=schema.names)

    if whole:                                       # all pairs are common: nothing is left to join
        return aligned.mapInArrow(run, schema).drop("_rare")
    path = scratch_path(spark, "align-scored")
    aligned.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        _with_row(run), T.StructType([*schema.fields, T.StructField("_row", T.LongType())])).write.parquet(path)
    scored = spark.read.parquet(path)
    rest = (scored.select("_row", F.explode("_rare").alias("_l")).select("_row", "_l.*").join(pairs, ["a", "b"])
            .groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("_best"),
                                 F.sum(F.col("m") * F.col("n")).alias("_sum")))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).cast("long").alias(c)
    return scored.join(rest, "_row", "left").select(
        *[f.name for f in kept], *_SCORED[:4], plus("n_best", "_best"), plus("count_sum", "_sum"), "groups_sha256")


def _with_row(run):
    """``run`` on batches that have a last column ``_row``, which is passed through (rows keep their order)."""
    def wrapped(batches):
        for batch in batches:
            rows, at = batch.column("_row"), 0
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, rows.slice(at, out.num_rows)], names=[*out.schema.names, "_row"])
                at += out.num_rows
    return wrapped


def audit(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", pair: Pair = Pair(),
          width: int = WIDTH, common: int = COMMON) -> DataFrame:
    """``align``, ``link_counts`` and ``score`` in a row, with stored tables between them."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tokens, links, scored = (scratch_path(spark, f"align-{n}") for n in ("tokens", "links", "result"))
    align(df, keep, text_col, pair, width).write.option("compression", "zstd").parquet(tokens)
    # rows of tokens are wide: a session of its own hands them to Python some thousand at a time
    narrow = spark.newSession()
    narrow.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    aligned = narrow.read.parquet(tokens)
    link_counts(aligned, pair).write.parquet(links)
    score(aligned, narrow.read.parquet(links), pair, common).write.parquet(scored)
    return spark.read.parquet(scored)
