"""How the sources of a language differ: term frequencies recounted through minimal perfect hashes.

Terms are runs of letters A-Z (lowered) and of characters beyond ASCII. A
language keeps the terms that at least ``min_docs`` of its documents hold.

Both passes cut the texts of a slab into terms with numpy and number the distinct
ones with Arrow. Pass 1 counts, for each (language, term), the documents that
hold it, exactly; tasks add up the documents of a slab before they emit. Pass 2 counts occurrences of kept terms per
(language, source). The kept terms go into a sharded minimal perfect hash:
levels of bits, on each of which a key that meets no other key claims a place;
the place's rank among all claimed ones is the key's slot. Every slot stores its
key, and a lookup counts only if the stored key is equal, so words that are not
kept never count. The hash is sent to all tasks; it holds the ``HOT`` most
frequent kept terms of at most ``LONGEST`` bytes at most, which bounds it to
some 60 MB. A task adds into dense arrays, one counter per slot of the
language for each group it meets, and emits them when they reach ``CELLS``
counters. Words that the hash lacks are thrown away if all kept terms are in
it; otherwise their counts are emitted and joined with the other kept terms.

Smoothed shares ``p = 1 + floor(10^9 * (count + 2) / (N + 2 V))`` and the values
``floor((p - q)^2 / (p + q))`` are integers throughout (long division in steps
of 1000, exact up to N + 2 V of 9 * 10^15). Pairs of sources are valued in tiles
of at most a block of terms and two blocks of sources; terms that no source of a
tile holds have one value for all of them and are only counted.

Defined results: null text, language or source count as ''. A group without
terms has all counts 0; a language without kept terms has pairs of value 0 and
no terms. Repeated rows are documents of their own. An empty table gives an
empty result. Only the three columns are read, so other names cannot clash.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.textops import mix, spans
from gazette.session import ensure_checkpoint_dir, scratch_path, ship_package

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
HOT = 1 << 19             # kept terms that every task gets
LONGEST = 96              # bytes of a language and term in the hash
SHARD = 1 << 11           # keys of a shard, about
CELLS = 1 << 24           # counters that a task holds
HOLD = 1 << 19            # words that a task holds before it adds them in or emits them
WORD = 16                 # bytes of text reckoned for each of them: slabs of up to HOLD * WORD bytes
GAMMA = 2.0               # bits of a level for each key that is left
LEVEL = 0x9E3779B97F4A7C15
TERM_BLOCK, SOURCE_BLOCK = 1024, 128
PIECE = 1 << 22           # bytes of a text that are split into terms at a time
TERM = re.compile(rb"[a-z\x80-\xff]+")
BREAK = re.compile(rb"[^a-z\x80-\xff]")


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, some megabytes at a time."""
    raw = text.encode().lower()             # of bytes: A-Z only
    at = 0
    while at < len(raw):
        gap = BREAK.search(raw, at + PIECE) if len(raw) - at > PIECE else None
        to = gap.start() if gap else len(raw)
        yield TERM.findall(raw, at, to)
        at = to


LOWER = np.arange(256, dtype=np.uint8)      # the byte of a term that a byte of text stands for, 0 between terms
LOWER[65:91] += 32
LOWER[[b for b in range(128) if not 97 <= LOWER[b] <= 122]] = 0


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(text of every term, its number, the distinct terms)`` of a slab of texts (``large_binary``)."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if at[0] == at[-1]:
        return np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.binary())
    low = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]]
    at = at - at[0]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = at[:-1][at[:-1] < at[-1]]
    first[begin] = inside[begin]                         # a term ends with its text
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(first), at)))
    edges = np.r_[np.flatnonzero(first[inside]), int(inside.sum())].astype(np.int32)
    raw = [None, pa.py_buffer(edges), pa.py_buffer(low[inside])]
    coded = pa.Array.from_buffers(pa.binary(), len(owner), raw).dictionary_encode()
    return owner, np.asarray(coded.indices, np.int64), coded.dictionary


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs (``np.unique`` is slower on so many)."""
    ordered = np.sort(values)
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    return ordered[start], np.diff(np.r_[start, len(ordered)])


def coded_terms(texts: pa.Array, hold: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, bool]]:
    """``(row of every term, its number, the distinct terms, whole)`` of a column, a slab at a time.

    Texts of more than a slab and ``PIECE`` bytes come in several parts, with ``whole`` false.
    """
    raw = texts.cast(pa.large_binary())
    sizes = pc.binary_length(raw).to_pylist()
    for lo, hi in spans(sizes, hold * WORD):
        if sizes[lo] > max(hold * WORD, PIECE):
            for part in terms(texts[lo].as_py()):
                coded = pa.array(part, pa.binary()).dictionary_encode()
                yield np.full(len(part), lo), np.asarray(coded.indices, np.int64), coded.dictionary, False
        else:
            owner, code, words = _split(raw.slice(lo, hi - lo))
            yield owner + lo, code, words, True


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


# --------------------------------------------------------------------------- pass 1
def document_frequencies(docs: DataFrame, hold: int = HOLD) -> DataFrame:
    """``lang, term, docs``: how many rows of a language hold the term."""
    def emit(lang, words, n):
        for lo in range(0, len(n), 1 << 16):
            part = n[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)).cast(pa.string()), words.slice(lo, len(part)).cast(pa.string()),
                                              pa.array(part, pa.int64())], names=["lang", "term", "docs"])

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            lang_of, names = np.asarray(langs.indices, np.int64), langs.dictionary.to_pylist()
            parts: dict[int, set[bytes]] = {}               # of texts that come in parts
            for row, code, words, whole in coded_terms(batch.column("text"), hold):
                if not whole:
                    parts.setdefault(int(row[0]), set()).update(words.to_pylist())
                    continue
                if len(code):
                    once, _ = _runs(row * len(words) + code)
                    row = once // len(words)
                    key, n = _runs(lang_of[row] * len(words) + once - row * len(words))
                    edges = np.searchsorted(key, np.arange(len(names) + 1) * len(words))
                    for lang, lo, hi in zip(names, edges, edges[1:], strict=False):
                        yield from emit(lang, words.take(pa.array(key[lo:hi] % len(words))), n[lo:hi])
            for row, found in parts.items():
                yield from emit(names[lang_of[row]], pa.array(list(found), pa.binary()), np.ones(len(found), np.int64))

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, term string, docs long")
    # dealt first: rows of a task hardly repeat, so adding them up before the shuffle would only cost a hash table
    return rows.repartition("lang", "term").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


# --------------------------------------------------------------------------- perfect hash
def key_of(lang: str, term: bytes) -> bytes:
    return lang.encode() + b"\0" + term       # no term holds a zero byte, so the last one is the seam


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """The hash that Spark's ``xxhash64`` gives the same bytes."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))


class PerfectHash:
    """Keys of a shard to slots 0 .. n-1, with the keys themselves in slot order."""

    def __init__(self, keys: list[bytes]):
        h = key_hashes(keys)
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        alone = times[back] == 1
        self.levels: list[np.ndarray] = []
        left = h[alone]
        while len(left):
            at = self._place(left, len(self.levels), max(64, int(GAMMA * len(left))))
            bits = np.bincount(at, minlength=max(64, int(GAMMA * len(left)))) == 1
            self.levels.append(bits)
            left = left[~bits[at]]
        self._ranks()
        slot = self._slots(h)
        twins = np.flatnonzero(~alone)                      # different keys with one hash have slots by name
        self.twins = {keys[i]: int(alone.sum()) + k for k, i in enumerate(twins)}
        slot[twins] = [self.twins[keys[i]] for i in twins]
        self.keys = pa.array([keys[i] for i in np.argsort(slot)], pa.binary())

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h + np.uint64((level + 1) * LEVEL % 2**64)) % np.uint64(size)).astype(np.int64)

    def _ranks(self) -> None:
        self.ranks, base = [], 0
        for bits in self.levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int32) - 1)
            base += int(bits.sum())

    def __getstate__(self):
        return [(len(b), np.packbits(b)) for b in self.levels], self.twins, self.keys

    def __setstate__(self, state):
        packed, self.twins, self.keys = state
        self.levels = [np.unpackbits(b)[:n].astype(bool) for n, b in packed]
        self._ranks()

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of every hash (any slot, or -1, for one that is no key's)."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(h[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def find(self, keys: pa.Array, h: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 if the key is not stored."""
        slot = self._slots(h)
        same = np.asarray(pc.equal(self.keys.take(pa.array(np.maximum(slot, 0))), keys)) if len(self.keys) else np.zeros(len(slot), bool)
        slot = np.where(same & (slot >= 0), slot, -1)
        if self.twins:
            for i, k in enumerate(keys.to_pylist()):
                slot[i] = self.twins.get(k, slot[i])
        return slot


class ShardedHash:
    """All shards of a perfect hash (their number a power of two), slots numbered through."""

    def __init__(self, shards: dict[int, bytes], n_shards: int):
        self.mask = np.uint64(n_shards - 1)
        self.shards = {s: pickle.loads(b) for s, b in shards.items()}
        self.base, n = {}, 0
        for s in sorted(self.shards):
            self.base[s] = n
            n += len(self.shards[s].keys)
        keys = [k for s in sorted(self.shards) for k in self.shards[s].keys.to_pylist()]
        # the term of each slot, its place among the slots of its language, and the slots of each language
        lang = [k[:k.rindex(b"\0")] for k in keys]
        self.terms = _strings([k[len(x) + 1:] for k, x in zip(keys, lang, strict=True)])
        self.of_lang: dict[bytes, np.ndarray] = {}
        order = sorted(range(n), key=lambda i: lang[i])
        self.place = np.zeros(n, np.int64)
        lo = 0
        while lo < n:
            hi = lo
            while hi < n and lang[order[hi]] == lang[order[lo]]:
                hi += 1
            own = np.array(order[lo:hi], np.int64)
            self.of_lang[lang[order[lo]]] = own
            self.place[own] = np.arange(hi - lo)
            lo = hi

    def find(self, keys: pa.Array) -> np.ndarray:
        """Slot of every key (``key_of``), -1 if it is not stored."""
        h = key_hashes(keys.to_pylist())
        out = np.full(len(keys), -1, np.int64)
        shard = (h & self.mask).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)) if len(order) else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            own = order[lo:hi]
            s = int(shard[own[0]])
            if s in self.shards:
                slot = self.shards[s].find(keys.take(pa.array(own)), h[own])
                out[own] = np.where(slot >= 0, slot + self.base[s], -1)
        return out


def build_shards(kept: DataFrame, n_shards: int) -> DataFrame:
    """``shard, hash``: the pickled perfect hash of every shard of (lang, term) rows."""
    def build(table: pa.Table) -> pa.Table:
        keys = [key_of(a, b.encode()) for a, b in zip(table.column("lang").to_pylist(), table.column("term").to_pylist(), strict=True)]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                         "hash": pa.array([pickle.dumps(PerfectHash(sorted(keys)))], pa.binary())})

    h = F.xxhash64(F.concat(F.col("lang"), F.lit("\0"), F.col("term")))
    rows = kept.select("lang", "term", h.bitwiseAND(F.lit(n_shards - 1)).cast("int").alias("shard"))
    return rows.groupBy("shard").applyInArrow(build, "shard int, hash binary")


# --------------------------------------------------------------------------- pass 2
class _Counters:
    """Dense counters of the groups that a task has met, and words that the hash lacks."""

    def __init__(self, table: ShardedHash, complete: bool, cells: int):
        self.table, self.complete, self.cells = table, complete, cells
        self.slots: dict[tuple[str, str], np.ndarray] = {}
        self.other: dict[tuple[str, str], dict[bytes, int]] = {}
        self.used = 0

    def add(self, groups: list[tuple[str, str]], group: np.ndarray, code: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
        """Adds terms: the group (place in ``groups``, one language after the other) and the number of each."""
        key, n = _runs(group * max(1, len(words)) + code)
        edges = np.searchsorted(key, np.arange(len(groups) + 1) * len(words))
        code = key % max(1, len(words))
        slots, of = np.empty(0, np.int64), None
        for i, g in enumerate(groups):
            own, times = code[edges[i]:edges[i + 1]], n[edges[i]:edges[i + 1]]
            if g[0] != of:                                   # looked up once for all groups of a language
                of, last = g[0], i
                while last < len(groups) and groups[last][0] == of:
                    last += 1
                used = np.unique(code[edges[i]:edges[last]])
                slots = np.full(len(words), -1, np.int64)
                slots[used] = self.table.find(pc.binary_join_element_wise(key_of(of, b""), words.take(pa.array(used)), b""))
            if g not in self.slots:
                size = len(self.table.of_lang.get(of.encode(), ()))
                if self.used + size > self.cells:
                    yield from self.emit()
                self.slots[g] = np.zeros(size, np.int64)
                self.used += size
            slot = slots[own]
            hit = slot >= 0
            self.slots[g][self.table.place[slot[hit]]] += times[hit]
            if not self.complete:
                rest = self.other.setdefault(g, {})
                for w, k in zip(words.take(pa.array(own[~hit])).to_pylist(), times[~hit].tolist(), strict=True):
                    rest[w] = rest.get(w, 0) + k
        if sum(map(len, self.other.values())) > HOLD:
            yield from self.emit()

    def emit(self) -> Iterator[pa.RecordBatch]:
        for g, count in self.slots.items():
            yield _rows(g, [None], [0], True)                # the group itself
            own = self.table.of_lang.get(g[0].encode())
            at = np.flatnonzero(count)
            for lo in range(0, len(at), 1 << 16):
                k = at[lo:lo + (1 << 16)]
                yield _rows(g, self.table.terms.take(pa.array(own[k])), count[k], True)
        for g, rest in self.other.items():
            words = list(rest)
            for lo in range(0, len(words), 1 << 16):
                part = words[lo:lo + (1 << 16)]
                yield _rows(g, part, [rest[w] for w in part], False)
        self.slots.clear()
        self.other.clear()
        self.used = 0


_COUNTS = "lang string, source string, term string, n long, known boolean"


def _rows(group: tuple[str, str], words, n, known: bool) -> pa.RecordBatch:
    k = len(words)
    terms_ = words if isinstance(words, pa.Array) else _strings(words)
    return pa.RecordBatch.from_arrays([pa.repeat(group[0], k).cast(pa.string()), pa.repeat(group[1], k).cast(pa.string()), terms_,
                                       pa.array(n, pa.int64()), pa.array(np.full(k, known))], names=["lang", "source", "term", "n", "known"])


@lru_cache(maxsize=1)
def _loaded(shared) -> ShardedHash:
    return ShardedHash(*shared.value)


def group_counts(docs: DataFrame, kept: DataFrame, hot: int = HOT, cells: int = CELLS, hold: int = HOLD) -> DataFrame:
    """``lang, source, term, n``: occurrences of kept terms in every group, and a row without term per group.

    ``kept`` (``lang, term, docs``) is read several times: pass a stored table.
    """
    spark = docs.sparkSession
    fits = F.octet_length("lang") + F.octet_length("term") <= LONGEST
    n_kept = kept.count()
    first = kept.filter(fits).orderBy(F.desc("docs"), "lang", "term").limit(hot)
    n_shards = 1 << max(0, (min(n_kept, hot) // SHARD).bit_length())
    shards = {r["shard"]: r["hash"] for r in build_shards(first, n_shards).collect()}      # at most `hot` keys of LONGEST bytes
    n_hot = sum(len(pickle.loads(b).keys) for b in shards.values())
    complete = n_hot == n_kept
    shared = spark.sparkContext.broadcast((shards, n_shards))

    def run(batches):
        state = _Counters(_loaded(shared), complete, cells)
        for batch in batches:
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            groups = sorted(set(pairs))
            place = {g: i for i, g in enumerate(groups)}
            group = np.array([place[p] for p in pairs], np.int64)
            for row, code, words, _ in coded_terms(batch.column("text"), hold):
                yield from state.add(groups, group[row], code, words)
        yield from state.emit()

    rows = docs.select("lang", "source", "text").mapInArrow(run, _COUNTS)
    rows = rows.repartition("lang", "source", "term")      # as in pass 1
    if complete:
        return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    path = scratch_path(spark, "divergence-rows")
    rows.groupBy("lang", "source", "term", "known").agg(F.sum("n").alias("n")).write.parquet(path)
    stored = spark.read.parquet(path)
    rest = stored.filter("NOT known").join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    return stored.filter("known").unionByName(rest.select(stored.columns)).select("lang", "source", "term", "n")


# --------------------------------------------------------------------------- values
def share(count, total):
    """``1 + floor(10^9 * count / total)`` of integer arrays, by long division."""
    q, r = np.divmod(count, total)
    for _ in range(3):
        d, r = np.divmod(r * 1000, total)
        q = q * 1000 + d
    return 1 + q


def share_sql(count: str, total: str) -> str:
    """The same as a Spark expression."""
    q, r = f"(({count}) div ({total}))", f"(({count}) % ({total}))"
    for _ in range(3):
        q, r = f"({q} * 1000 + ({r} * 1000) div ({total}))", f"(({r} * 1000) % ({total}))"
    return f"(1 + {q})"


def value_of(p, q):
    return (p - q) * (p - q) // (p + q)


def _tile(table: pa.Table) -> pa.Table:
    """Partial values of all pairs of sources between the two source blocks of a tile."""
    source = table.column("source").combine_chunks()
    names = pc.unique(source).sort()          # not as rows arrive: all tiles of a pair must name it the same way round
    who = np.asarray(pc.index_in(source, names))
    marker = np.asarray(pc.is_null(table.column("term")))
    n, block, total, v = (np.asarray(table.column(c)) for c in ("n", "sb", "total", "v"))
    size = len(names)
    sums, sb = np.zeros(size, np.int64), np.zeros(size, np.int64)
    sums[who[marker]], sb[who[marker]] = total[marker], block[marker]
    kept = int(v[0])
    m = sums + 2 * kept
    base = share(np.full(size, 2, np.int64), m) if kept else np.zeros(size, np.int64)
    term = np.asarray(table.column("term").filter(pa.array(~marker)).combine_chunks().dictionary_encode().indices, np.int64)
    seen = int(term.max()) + 1 if len(term) else 0
    p = np.repeat(base[:, None], seen, axis=1)
    row = who[~marker]
    p[row, term] = share(n[~marker] + 2, m[row])
    x, y = int(table.column("x")[0].as_py()), int(table.column("y")[0].as_py())
    left = np.flatnonzero(sb == x)
    right = np.flatnonzero(sb == y)
    a, b, part, rest = [], [], [], []
    for i in left:
        j = right[right > i] if x == y else right
        if len(j):
            a.append(np.full(len(j), i))
            b.append(j)
            part.append(value_of(p[i], p[j]).sum(axis=1))
            rest.append(value_of(base[i], base[j]) if kept else np.zeros(len(j), np.int64))
    cat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    a, b, part, rest = cat(a), cat(b), cat(part), cat(rest)
    k = len(a)
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * k, pa.string()),
                     "a": names.take(pa.array(a)).cast(pa.string()), "b": names.take(pa.array(b)).cast(pa.string()),
                     "part": part, "seen": np.full(k, seen, np.int64), "base": rest, "v": np.full(k, kept, np.int64)})


def pair_values(counts: DataFrame, groups: DataFrame, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language, both ways."""
    blocks = (F.greatest(F.lit(1), F.ceil(F.col("v") / F.lit(term_block))).cast("long").alias("nb"),
              F.ceil(F.col("sources") / F.lit(source_block)).cast("long").alias("ns"))
    g = groups.select("lang", "source", "total", "v", *blocks)
    g = g.withColumn("sb", F.pmod(F.xxhash64("source"), F.col("ns")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("ns") - 1)).alias("o")
    place = ("lang", "tb", F.least("sb", "o").alias("x"), F.greatest("sb", "o").alias("y"), "source", "sb", "total", "v", "term", "n")
    markers = (g.withColumn("tb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).select("*", other)
               .withColumn("term", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("long")).select(*place))
    cells = (counts.filter("term IS NOT NULL AND n > 0").join(g, ["lang", "source"])
             .withColumn("tb", F.pmod(F.xxhash64("term"), F.col("nb"))).select("*", other).select(*place))
    tiles = markers.unionByName(cells).groupBy("lang", "tb", "x", "y").applyInArrow(
        _tile, "lang string, a string, b string, part long, seen long, base long, v long")
    value = F.sum("part") + (F.max("v") - F.sum("seen")) * F.max("base")
    pairs = tiles.groupBy("lang", "a", "b").agg(value.alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return pairs.select("lang", both.alias("_p"), "value").select("lang", "_p.*", "value")


def term_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms that a group holds more often than its language."""
    cells = counts.filter("term IS NOT NULL AND n > 0")
    whole = cells.groupBy("lang", "term").agg(F.sum("n").alias("ln"))
    rows = cells.join(whole, ["lang", "term"]).join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr(share_sql("n + 2", "total + 2 * v")).alias("p"),
                       F.expr(share_sql("ln + 2", "lang_total + 2 * v")).alias("q")).filter("p > q")
    return rows.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, hot: int = HOT, cells: int = CELLS, hold: int = HOLD,
          term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source against the others of its language (part ``pair``, all
    ranks) and its most telling terms (part ``term``, ranks up to ``top``)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    docs = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    path = scratch_path(spark, "divergence-kept")
    document_frequencies(docs, hold).filter(F.col("docs") >= min_docs).write.parquet(path)
    kept = spark.read.parquet(path)
    path = scratch_path(spark, "divergence-counts")
    group_counts(docs, kept, hot, cells, hold).write.parquet(path)
    counts = spark.read.parquet(path)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, ["v"])
    groups = totals.join(langs, "lang").checkpoint()
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by).alias("rank")
    pairs = pair_values(counts, groups, term_block, source_block).select("*", rank)
    best = term_values(counts, groups).select("*", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
