"""Exact removal of repeated byte strings with sharded suffix arrays.

Each byte that lies in a ``LENGTH``-byte string which also starts earlier (in a
document of smaller id, or earlier in the same one) is removed. Strings never
cross documents and are judged on the input.

1. Every window of ``LENGTH`` bytes has a minimiser: the least hash of its
   ``GRAM``-byte strings. Equal windows have equal minimisers, so runs of
   windows with one minimiser can be dealt by it. A minimiser that occurs once
   in the corpus has no repeated window; a count over packed hashes (10 bytes
   per run, about one run for 35 windows) finds the others.
2. Runs with a repeated minimiser are cut out of their documents and dealt to
   shards by minimiser. A minimiser with more text than a shard holds is dealt
   to several shards, by slab.
3. Each shard builds a suffix array of its runs by Larsson-Sadakane refinement
   (ranks by 8 bytes, then 16, 32, 64 and ``LENGTH``; only unsorted groups are
   sorted again) and its common prefixes by Kasai's rule, all in numpy. Equal
   neighbours are repeats; the earliest one stays. The arrays take some 50
   times the text, so a shard goes through them in pieces, by minimiser.
4. Minimisers of several shards: every shard sends the hashes of its earliest
   windows as sorted runs, dealt by hash; they are merged by binary search and
   later windows of a hash are repeats too.
5. The spans return to their slab, are joined and cut out.

Memory is bounded by a slab, a shard or a hash bucket; no step gathers the
rows of a key without bound: identical text is pre-aggregated in each shard.

Slabs are cut by rows and text bytes, whatever the Arrow batches, and numbered in
scan order, so ``docs`` must give the same partitions when read again (a file
scan, or a checkpointed frame); a checksum guards each of the three reads.

Defined results: null text has no bytes; texts below ``LENGTH`` bytes lose
nothing; of rows with equal ids the one read first counts as earlier; a null
id comes before all others; ids must be integers; an empty table gives an
empty result; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import textops as T
from gazette.session import scratch_path

LENGTH = 100
GRAM = 32
SLAB = 4_000_000
SLAB_ROWS = 10_000          # a document's place in its slab has 16 bits
SHARD = 2_000_000           # bytes of run text a shard should hold
PIECES = 4                  # parts of a shard (by minimiser) that are sorted one after the other
BLOCK = 1 << 19             # strings that are hashed at a time
RUN = 127                   # windows of a run at most
SELF = 128                  # marks a run whose minimiser occurs in it more than once
REST = np.uint64((1 << 40) - 1)
NULL_ID = -(1 << 63)
BYTE = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)    # lowest bit of each byte of a word
_WAY: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- minimisers
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_WAY.get("up", ())) < n:
        size = max(n, 1 << 20)
        _WAY["up"], _WAY["down"] = T.powers(T.BASE, size), T.powers(T.BASE_INV, size)
    return _WAY["up"], _WAY["down"]


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size``-byte string of ``raw``, which does not depend on its place; block by block."""
    if len(raw) < size:
        return np.empty(0, np.uint64)
    return np.concatenate([_block_hashes(raw[a:a + BLOCK + size - 1], size) for a in range(0, len(raw) - size + 1, BLOCK)])


def _block_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    n = len(raw)
    up, down = _powers(n + 1)
    fold = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=fold[1:])
    return T.mix((fold[size:] - fold[:-size]) * down[:n - size + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    more = width - have
    return np.minimum(x[:-more], x[more:]) if more else x


def runs_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """``(start in the joined texts, number of windows, minimiser)`` of all runs.

    A run is at most ``RUN`` windows; if its minimiser moves inside it (text of
    a short period), ``SELF`` is added to the number.
    """
    starts, sizes, minis = [], [], []
    base = 0
    for _, some in T.slabs(texts, 1 << 19):
        raw = np.frombuffer(b"".join(some), np.uint8)
        if len(raw) >= length:
            hashes = gram_hashes(raw, gram)
            least = sliding_min(hashes, length - gram + 1)      # per window
            valid = np.zeros(len(raw) + 1, bool)
            new = np.zeros(len(raw) + 1, bool)
            at = 0
            for t in some:
                if len(t) >= length:
                    valid[at:at + len(t) - length + 1] = True
                    new[at] = True
                at += len(t)
            valid, new = valid[:len(least)], new[:len(least)]
            new[1:] |= least[1:] != least[:-1]
            new &= valid
            s = np.flatnonzero(new)
            # a run ends where the next begins or validity does
            stop = np.flatnonzero(valid & ~np.r_[valid[1:], False]) + 1
            e = np.minimum(np.r_[s[1:], len(least)], stop[np.searchsorted(stop, s, "right")])
            moved = np.r_[False, (hashes[:len(least) - 1] == least[:-1]) & (least[1:] == least[:-1])]
            total = np.r_[0, np.cumsum(moved)]
            inside = np.where(total[e] - total[np.minimum(s + 1, e)] > 0, SELF, 0)
            pieces = (e - s + RUN - 1) // RUN
            if (pieces > 1).any():                      # long runs in pieces
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                s2 = np.repeat(s, pieces) + nth * RUN
                e = np.minimum(np.repeat(e, pieces), s2 + RUN)
                m, inside = np.repeat(least[s], pieces), np.repeat(inside, pieces)
                s = s2
            else:
                m = least[s]
            starts.append(s + base)
            sizes.append(e - s + inside)
            minis.append(m)
        base += len(raw)
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(minis)


def _texts(pieces: list[pa.RecordBatch]) -> list[bytes]:
    return [t or b"" for piece in pieces for t in piece.column("_text").to_pylist()]


def _slabs(batches: Iterator[pa.RecordBatch]):
    """``(slab, pieces of batches, texts)``; where a slab ends depends on the partition's rows and texts only.

    Only the texts of a slab become Python objects."""
    slab = T.first_slab(TaskContext.get().partitionId())
    pieces: list[pa.RecordBatch] = []
    rows = total = 0
    for b in batches:
        start = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column("_text")), 0).to_pylist()):
            if rows and (rows == SLAB_ROWS or total + n > SLAB):
                if i > start:
                    pieces.append(b.slice(start, i - start))
                yield slab, pieces, _texts(pieces)
                slab, start, pieces, rows, total = slab + 1, i, [], 0, 0
            rows += 1
            total += n
        if start < b.num_rows:
            pieces.append(b.slice(start))
    if rows:
        yield slab, pieces, _texts(pieces)


def _check(texts: list[bytes]) -> int:
    out = 0
    for t in texts:
        out = zlib.crc32(t, zlib.crc32(len(t).to_bytes(8), out))
    return out


def _same(found: pa.Table, slab: pa.Table) -> None:
    marks = {m for m in found.column("mark").to_pylist() if m is not None}
    if marks and marks != set(slab.column("mark").to_pylist()):
        raise RuntimeError("the input gave other rows when read again; checkpoint it first")


def _count_pass(buckets: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, _, texts in _slabs(batches):
            start, size, mini = runs_of(texts, length, gram)
            bucket = ((mini >> np.uint64(44)) % np.uint64(buckets)).astype(np.int32)
            rest = mini & REST
            order = np.lexsort((rest, bucket))
            bucket, rest, start, size = bucket[order], rest[order], start[order].astype(np.uint32), size[order].astype(np.uint8)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
            mark = _check(texts)
            rows = [(slab, mark, int(bucket[x]), T.pack40(rest[x:y]), start[x:y].tobytes(), size[x:y].tobytes())
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                    ["slab", "mark", "bucket", "rest", "start", "size"])
    return run


_REPEATED = "slab long, mark long, n long, start binary, size binary, mini binary, parts binary"


def _repeated_runs(shard: int):
    def run(table: pa.Table) -> pa.Table:
        """Runs of one bucket whose minimiser occurs twice or more, and over how many shards it is dealt."""
        bucket = np.uint64(table.column("bucket")[0].as_py())
        parts = [T.unpack40(x) for x in table.column("rest").to_pylist()]
        sizes = [np.frombuffer(x, np.uint8) for x in table.column("size").to_pylist()]
        rest, size = np.concatenate(parts), np.concatenate(sizes)
        alone, size = size < SELF, (size & RUN).astype(np.int64) + LENGTH
        order = np.argsort(rest, kind="stable")
        s = rest[order]
        cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        count, text = np.diff(np.r_[cut, len(s)]), np.add.reduceat(size[order], cut)
        often, deal = np.empty(len(s), bool), np.empty(len(s), np.uint32)
        often[order] = np.repeat(count > 1, count)
        often |= ~alone
        deal[order] = np.repeat(-(-text // shard), count)
        at, out = 0, []
        for slab, mark, r, b, z in zip(table.column("slab").to_pylist(), table.column("mark").to_pylist(), parts,
                                       table.column("start").to_pylist(), sizes, strict=True):
            keep = often[at:at + len(r)]
            if keep.any():
                out.append((slab, mark, int(keep.sum()), np.frombuffer(b, np.uint32)[keep].tobytes(), (z[keep] & RUN).tobytes(),
                            (r[keep] | bucket << np.uint64(40)).tobytes(), deal[at:at + len(r)][keep].tobytes()))
            at += len(r)
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        cols = list(zip(*out, strict=True)) or [[]] * 7
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                    ["slab", "mark", "n", "start", "size", "mini", "parts"])
    return run


# ---------------------------------------------------------------- slabs with their texts
def _payload_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slab's rows as one compressed Arrow stream."""
    for slab, pieces, texts in _slabs(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pieces[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for piece in pieces:
                w.write_batch(piece)
        yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int64()), pa.array([_check(texts)], pa.int64()),
                                          pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slab", "mark", "rows"])


def _rows(table: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(table.column("rows")[0].as_py()).read_all()


_RUNS = "shard long, text binary, meta binary"
META = np.dtype([("id", "<i8"), ("row", "<i8"), ("start", "<u4"), ("n", "<u2"), ("parts", "<u4"), ("piece", "<u1")])


def _cut_runs(shards: int, length: int):
    def run(spans: pa.Table, slab: pa.Table) -> pa.Table:
        """The repeated runs of one slab, packed by shard."""
        out: list[tuple] = []
        if spans.num_rows:
            _same(spans, slab)
            rows = _rows(slab)
            number = slab.column("slab")[0].as_py()
            texts = [t or b"" for t in rows.column("_text").to_pylist()]
            ids = np.array([NULL_ID if i is None else i for i in rows.column("_id").to_pylist()], np.int64)
            whole = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            get = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in spans.column(c).to_pylist()])
            start, size, mini, parts = get("start", np.uint32), get("size", np.uint8), get("mini", np.uint64), get("parts", np.uint32)
            place = np.searchsorted(ends, start, "right")
            meta = np.zeros(len(start), META)
            meta["id"], meta["row"] = ids[place], (number << 16) | place
            meta["start"] = start - (ends[place] - np.array([len(t) for t in texts])[place])
            meta["n"], meta["parts"] = size, parts
            mixed = T.mix(mini)
            shard = (mixed % np.uint64(shards)).astype(np.int64)
            meta["piece"] = mixed // np.uint64(shards) % np.uint64(PIECES)
            own = parts > 1                              # dealt over several shards, by slab
            split = T.mix(np.array([number], np.uint64))[0] % np.maximum(parts, 1).astype(np.uint64)
            shard[own] = shards + (T.mix(mini[own] + split[own] * T.PLACE[0]) >> np.uint64(2)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[x:y]
                text = b"".join([whole[a:a + n + length - 1] for a, n in zip(start[own].tolist(), size[own].tolist(), strict=True)])
                out.append((int(shard[own[0]]), text, meta[own].tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                    ["shard", "text", "meta"])
    return run


# ---------------------------------------------------------------- suffix array of a shard
def sorted_windows(raw: np.ndarray, end: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Window starts that may repeat, in the order of their first ``length`` bytes.

    ``end[i]`` is where the run of position i ends. Ranks by 8 bytes are
    refined by doubling; positions alone in their group are done
    (Larsson-Sadakane) and those too near the end of their run are not needed.
    """
    n = len(raw)
    key = np.zeros(n, np.uint64)
    padded = np.r_[raw, np.zeros(8, np.uint8)]
    for k in range(8):
        key <<= np.uint64(8)
        key |= padded[k:n + k]
    rank = np.zeros(n, np.int32)
    order = np.flatnonzero(np.arange(8, n + 8, dtype=np.int32) <= end).astype(np.int32)
    order = order[np.argsort(key[order], kind="stable")]
    value, h = key[order], 8
    del key, padded
    old = np.zeros(len(order), np.int32)                # rank of the group that is being split
    steps = [x for x in (16, 32, 64) if x <= length] + [length]
    while True:
        new = np.r_[True, (value[1:] != value[:-1]) | (old[1:] != old[:-1])] if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new).astype(np.int32)
        fresh = np.flatnonzero(np.r_[True, old[1:] != old[:-1]]).astype(np.int32) if len(order) else first
        many = np.diff(np.r_[first, len(order)])
        old -= np.repeat(fresh, np.diff(np.r_[fresh, len(order)]))
        old += np.repeat(first, many)
        rank[order] = old
        order = order[np.repeat(many > 1, many)]
        del value, old, new
        if not steps:
            return order
        to = steps.pop(0)
        order = order[order + to <= end[order]]
        old, follow = rank[order], rank[order + (to - h)]
        sort = np.lexsort((follow, old))
        order, old, value, h = order[sort], old[sort], follow[sort], to
        del follow, sort


def common_prefixes(raw: np.ndarray, order: np.ndarray, begin: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Common prefix (up to ``length``) of each sorted window with the one before it.

    Kasai's rule, all runs in step: the window one to the right of i shares at
    least one byte less with its predecessor, if the predecessor's right
    neighbour is also sorted and comes before it.
    """
    n = len(raw)
    place = np.full(n + 1, -1, np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    before = np.full(n + 1, -1, np.int32)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(n + 1, np.int32)
    padded = np.r_[raw, np.zeros(length + 8, np.uint8)]
    word = np.ndarray(n + length + 1, "<u8", padded, strides=(1,))      # the eight bytes from each place on
    todo = np.sort(order)
    depth = todo - begin[todo]                           # windows of one depth in their run are handled together
    by = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(depth[by]) != 0, True])
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        i = todo[by[x:y]]
        p = before[i]
        i, p = i[p >= 0], p[p >= 0]
        q = before[i - 1] + 1
        known = (depth[by[x]] > 0) & (place[i - 1] >= 0) & (q > 0) & (place[q] >= 0) & (place[q] < place[i])
        h = np.where(known, np.maximum(lcp[i - 1] - 1, 0), 0)
        go = np.flatnonzero(h < length)
        while len(go):
            differ = word[i[go] + h[go]] ^ word[p[go] + h[go]]
            low = differ & (~differ + np.uint64(1))                     # its lowest bit is in the first byte that differs
            h[go] += np.where(differ == 0, 8, np.searchsorted(BYTE, low, "right") - 1).astype(np.int32)
            go = go[(differ == 0) & (h[go] < length)]
        lcp[i] = np.minimum(h, length)
    return lcp[order]


def shard_repeats(text: bytes, meta: np.ndarray, length: int = LENGTH):
    """For the runs of a shard: ``repeat[i]`` of every window (runs joined), and each run's first window index.

    A window is a repeat if an equal one comes earlier (by id, row, start) in
    the shard.
    """
    size = meta["n"].astype(np.int64)
    span = size + length - 1
    cut = np.r_[0, np.cumsum(span)]
    first = np.r_[0, np.cumsum(size)]
    repeat = np.zeros(first[-1], bool)
    rank = np.empty(len(meta), np.int64)
    by = np.lexsort((meta["start"], meta["row"], meta["id"]))
    rank[by] = np.arange(len(meta))
    seen: set[bytes] = set()
    keep = []
    for k in by.tolist():                                # equal runs: only the earliest goes on
        t = text[cut[k]:cut[k + 1]]
        if t in seen:
            repeat[first[k]:first[k + 1]] = True
        else:
            seen.add(t)
            keep.append(k)
    kept = np.array(keep, np.int64)
    raw = np.frombuffer(b"".join([text[cut[k]:cut[k + 1]] for k in keep]), np.uint8)
    del seen
    s = span[kept]
    if s.sum() + length + 8 >= 1 << 31:
        raise ValueError("a shard's runs go over 2 GB")
    begin = np.repeat((np.cumsum(s) - s).astype(np.int32), s)
    order = sorted_windows(raw, begin + np.repeat(s.astype(np.int32), s), length)
    if len(order):
        lcp = common_prefixes(raw, order, begin, length)
        start = np.flatnonzero(np.r_[True, lcp[1:] < length])
        owner = kept[np.repeat(np.arange(len(kept), dtype=np.int32), s)[order]]
        offset = order - begin[order]
        when = rank[owner] * 65_536 + offset
        earliest = np.repeat(np.minimum.reduceat(when, start), np.diff(np.r_[start, len(order)]))
        late = when != earliest
        repeat[first[owner[late]] + offset[late]] = True
    return repeat, first


_FOUND = "slab long, spans binary, range int, windows binary"
SPAN = np.dtype([("place", "<u2"), ("a", "<u4"), ("b", "<u4")])
WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("row", "<i8"), ("at", "<u4")])


def _span_rows(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    slab = row >> 16
    order = np.argsort(slab, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(slab[order]) != 0, True]) if len(order) else np.zeros(1, int)
    out = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[x:y]
        s = np.zeros(len(k), SPAN)
        s["place"], s["a"], s["b"] = row[k] & 0xFFFF, a[k], b[k]
        out.append((int(slab[k[0]]), s.tobytes(), None, None))
    return out


def _found_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)],
                                ["slab", "spans", "range", "windows"])


def _pieces(text: bytes, meta: np.ndarray, length: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """The runs of a shard in pieces; equal windows have one minimiser, so they are in one piece."""
    cut = np.r_[0, np.cumsum(meta["n"].astype(np.int64) + length - 1)].tolist()
    for p in np.unique(meta["piece"]).tolist():
        own = np.flatnonzero(meta["piece"] == p)
        yield b"".join([text[cut[k]:cut[k + 1]] for k in own.tolist()]), meta[own]


def _shard_pass(ranges: int, length: int):
    def piece(text: bytes, meta: np.ndarray):
        """``(row, a, b)`` of the maximal runs of repeats; windows that other shards may have too, by range."""
        repeat, first = shard_repeats(text, meta, length)
        owner = np.repeat(np.arange(len(meta), dtype=np.int32), meta["n"])
        offset = np.arange(len(owner), dtype=np.int32) - first.astype(np.int32)[owner]
        starts = np.flatnonzero(repeat & ~(np.r_[False, repeat[:-1]] & (offset > 0)))
        nxt = np.r_[repeat[1:] & (offset[1:] > 0), False]
        stops = np.flatnonzero(repeat & ~nxt)
        m = meta[owner[starts]]
        spans = m["row"], m["start"].astype(np.int64) + offset[starts], m["start"].astype(np.int64) + offset[stops] + length
        rows = []
        shared = np.flatnonzero(~repeat & (meta["parts"][owner] > 1))
        if len(shared):
            raw = np.frombuffer(text, np.uint8)
            span = meta["n"].astype(np.int64) + length - 1
            at = (np.cumsum(span) - span)[owner[shared]] + offset[shared]
            w = np.zeros(len(shared), WINDOW)
            w["h"] = gram_hashes(raw, length)[at]
            w["g"] = T.mix(gram_hashes(raw ^ np.uint8(0x5A), length)[at])
            o = meta[owner[shared]]
            w["id"], w["row"], w["at"] = o["id"], o["row"], o["start"] + offset[shared]
            w = w[np.lexsort((w["g"], w["h"]))]
            part = (w["h"] >> np.uint64(20)) % np.uint64(ranges)
            for r in np.unique(part):
                rows.append((None, None, int(r), w[part == r].tobytes()))
        return spans, rows

    def run(table: pa.Table) -> pa.Table:
        text = b"".join(table.column("text").to_pylist())
        meta = np.concatenate([np.frombuffer(x, META) for x in table.column("meta").to_pylist()])
        spans, windows = [], []
        for some, own in _pieces(text, meta, length):
            found, rows = piece(some, own)
            spans.append(found)
            windows += rows
        return _found_table(_span_rows(*[np.concatenate(c) for c in zip(*spans, strict=True)]) + windows)
    return run


def merge_runs(runs: list[np.ndarray], length: int = LENGTH) -> list[tuple]:
    """Spans of windows that another shard has earlier; ``runs`` are sorted by hash and free of repeats.

    Runs are merged into one sorted table of the earliest window of each hash;
    places are found by binary search, and of two equal hashes the later
    window is a repeat.
    """
    best = np.zeros(0, WINDOW)
    late = []
    for w in runs:
        # binary search by h; the few windows with one h and several g are searched one by one
        at = np.searchsorted(best["h"], w["h"])
        same = np.zeros(len(w), bool)
        for k in range(4):
            p = np.minimum(at + k, max(0, len(best) - 1))
            if not len(best):
                break
            hit = ~same & (at + k < len(best)) & (best["h"][p] == w["h"]) & (best["g"][p] == w["g"])
            at = np.where(hit, p, at)
            same |= hit
        p = at[same]
        mine, other = w[same], best[p]
        earlier = (mine["id"] < other["id"]) | (mine["id"] == other["id"]) & (
            (mine["row"] < other["row"]) | (mine["row"] == other["row"]) & (mine["at"] < other["at"]))
        late.append(np.where(earlier, other, mine))
        best[p] = np.where(earlier, mine, other)
        best = np.insert(best, at[~same], w[~same])
    found = np.concatenate(late) if late else best
    return _span_rows(found["row"], found["at"].astype(np.int64), found["at"].astype(np.int64) + length)


def _merge_pass(length: int):
    def run(table: pa.Table) -> pa.Table:
        return _found_table(merge_runs([np.frombuffer(x, WINDOW) for x in table.column("windows").to_pylist()], length))
    return run


# ---------------------------------------------------------------- result
def join_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal spans (rows a, b) of overlapping or touching ones."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.r_[first[1:] - 1, len(spans) - 1]]], axis=1)


def _cut_pass(schema: pa.Schema, with_text: bool):
    def run(found: pa.Table, slab: pa.Table) -> pa.Table:
        _same(found, slab)
        rows = _rows(slab)
        texts = [t or b"" for t in rows.column("_text").to_pylist()]
        spans = np.concatenate([np.frombuffer(x, SPAN) for x in found.column("spans").to_pylist() if x is not None] or [np.zeros(0, SPAN)])
        spans = spans[np.argsort(spans["place"], kind="stable")]
        cuts = np.searchsorted(spans["place"], np.arange(len(texts) + 1))
        out: list[list] = [[], [], [], [], [], []]
        for k, t in enumerate(texts):
            own = spans[cuts[k]:cuts[k + 1]]
            gone = join_spans(np.stack([own["a"], own["b"]], axis=1).astype(np.int64)).tolist()
            kept, at = [], 0
            for a, b in gone:
                kept.append(t[at:a])
                at = b
            kept = b"".join([*kept, t[at:]])
            for c, v in zip(out, (len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(),
                                  [{"a": a, "b": b} for a, b in gone],
                                  kept.decode("utf-8", "ignore") if with_text else None), strict=True):
                c.append(v)
        new = [pa.array(c, f.type) for c, f in zip(out, list(schema)[-6:], strict=True)]
        cols = [rows.column(f.name) for f in list(schema)[:-6]]
        return pa.Table.from_arrays([*cols, *new], [f.name for f in schema])
    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                with_text: bool = False, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """``keep`` columns plus ``n_bytes, n_removed, n_spans, kept_sha256, removed_spans, kept`` (the text that stays, if
    ``with_text``; a character that lost a byte is left out)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    keep = [id_col] if keep is None else keep
    src = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(id_col).cast("long").alias("_id"),
                      F.col(text_col).cast("binary").alias("_text"))
    slim = src.select("_text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text_bytes = slim.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = T.bucket_count(text_bytes, partitions)

    path = scratch_path(spark, "suffix-runs")
    (slim.mapInArrow(_count_pass(buckets, length, gram),
                     "slab long, mark long, bucket int, rest binary, start binary, size binary")
     .groupBy("bucket").applyInArrow(_repeated_runs(shard), _REPEATED).write.parquet(path))
    repeated = spark.read.parquet(path)
    runs = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-runs * (length + (length - gram) // 2) // shard))

    # all reads are of the same scan, so slab numbers agree; the checksum guards it
    slabs = src.select("_id", "_text").mapInArrow(_payload_pass, "slab long, mark long, rows binary")
    cut = repeated.groupBy("slab").cogroup(slabs.groupBy("slab")).applyInArrow(_cut_runs(shards, length), _RUNS)
    path = scratch_path(spark, "suffix-found")
    cut.groupBy("shard").applyInArrow(_shard_pass(max(partitions, buckets // 16), length), _FOUND).write.parquet(path)
    found = spark.read.parquet(path)
    merged = found.filter("range IS NOT NULL").select("range", "windows").groupBy("range").applyInArrow(_merge_pass(length), _FOUND)
    # with the checksum of each slab that has spans, for the last read
    spans = (found.filter("slab IS NOT NULL").select("slab", "spans").unionByName(merged.select("slab", "spans"))
             .unionByName(repeated.select("slab", "mark").distinct(), allowMissingColumns=True))

    kinds = [f.dataType.simpleString() for f in src.schema.fields[:len(keep)]]
    ddl = ("".join(f"_k{i} {k}, " for i, k in enumerate(kinds))
           + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans array<struct<a:long,b:long>>, kept string")
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    slabs = src.mapInArrow(_payload_pass, "slab long, mark long, rows binary")
    out = spans.groupBy("slab").cogroup(slabs.groupBy("slab")).applyInArrow(_cut_pass(schema, with_text), ddl)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans",
                      "kept_sha256", "removed_spans", "kept")
