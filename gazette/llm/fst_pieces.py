"""SentencePiece-style encoding and decoding as shortest paths of a weighted transducer.

Two weighted transducers are compiled from a vocabulary file and composed:

* the normaliser reads bytes and writes bytes and marks: a mark before the text and
  a mark for every space, all else unchanged (the bytes of a mark character in the text
  stay bytes, so they are never read as a space, which keeps decoding exact);
* the pieces read bytes and marks and write piece ids: a path of states per piece
  that goes back to the start writing its id with a weight ``-log p``, ``p`` a Zipf
  law over the file's scores (minus the merge rank); byte fallback: for each
  byte without a piece of its own a path that writes its byte piece, heavier
  than any piece.

``Transducer`` holds their composition as tables. ``shortest`` composes it with
an input, which is a chain of its bytes, and takes the
tropical-semiring (min, +) shortest path; on equal weight at a place the path
whose last piece starts first wins. No piece has a mark after another character, so the
composed lattice falls apart at every such place and the best path of a text
is the concatenation of the best paths of its chunks; each task keeps the
paths of chunks it has seen (at most ``CACHE`` of them, then starts afresh).
A chunk of any length takes memory in proportion to its bytes.

A narrow job: no shuffle, texts of together ``BATCH_BYTES`` bytes (one at
least) at a time. Defined results: null text encodes like the empty text, to the id of
the bare mark; repeated rows and ties each get their row; extra columns are
dropped by the query, kept by ``encode``.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import textops as T
from gazette.llm import vocab as V
from gazette.llm.lattice_lm import initial_weights
from gazette.llm.trie import LONG, PieceTrie, Tables, by_length, compiled, surfaces

CACHE = 500_000
EPS, MARK = -1, 256          # no symbol; the mark, beside the 256 bytes
BATCH_BYTES = 1_000_000


@dataclass
class Fst:
    """A weighted transducer: ``arcs[state]`` are (input, output, weight, next state); it starts in state 0."""

    arcs: list[list[tuple[int, int, float, int]]]
    final: set[int]


def normaliser() -> Fst:
    """Bytes to bytes and marks."""
    return Fst([[(EPS, MARK, 0.0, 1)], [(b, MARK if b == 32 else b, 0.0, 1) for b in range(256)]], {1})


def piece_machine(vocabulary: V.Vocabulary, weights: np.ndarray) -> Fst:
    """Bytes and marks to piece ids."""
    arcs: list[list[tuple[int, int, float, int]]] = [[]]
    states: dict[tuple[int, int], int] = {}

    def path(symbols: list[int], piece: int) -> None:
        at = 0
        for x in symbols:
            if (at, x) not in states:
                states[at, x] = len(arcs)
                arcs[at].append((x, EPS, 0.0, len(arcs)))
                arcs.append([])
            at = states[at, x]
        arcs[at].append((EPS, piece, float(weights[piece]), 0))

    alone = set()
    for i, p in enumerate(vocabulary.pieces):
        if p:
            symbols = [x for k, part in enumerate(p.split(V.MARK_BYTES)) for x in ([MARK] if k else []) + list(part)]
            path(symbols, i)
            if len(symbols) == 1:
                alone.add(symbols[0])
    for b, i in enumerate(vocabulary.byte_ids):
        if b not in alone:
            path([b], i)
    return Fst(arcs, {0})


def compose(a: Fst, b: Fst) -> Fst:
    """The machine that reads what ``a`` reads and writes what ``b`` makes of ``a``'s output (``a`` writes a symbol on every arc)."""
    by_output = [{} for _ in a.arcs]
    for p, own in enumerate(a.arcs):
        for i, o, w, q in own:
            by_output[p].setdefault(o, []).append((i, w, q))
    names, todo, arcs = {(0, 0): 0}, [(0, 0)], [[]]

    def state(pair: tuple[int, int]) -> int:
        if pair not in names:
            names[pair] = len(todo)
            todo.append(pair)
            arcs.append([])
        return names[pair]

    for p, q in todo:                                       # grows while it is read
        own = arcs[names[p, q]]
        for i, o, w, r in b.arcs[q]:
            if i == EPS:
                own.append((EPS, o, w, state((p, r))))
            else:
                own += [(x, o, w + v, state((s, r))) for x, v, s in by_output[p].get(i, ())]
    return Fst(arcs, {n for (p, q), n in names.items() if p in a.final and q in b.final})


def tables(machine: Fst) -> tuple[Tables, int]:
    """The composed machine as ``Tables`` over bytes from its home state on, and its number of states.

    Home is the state that writing a piece leads back to; the mark before a text is read as a space.
    """
    homes = {n for own in machine.arcs for i, o, _, n in own if i == EPS and o != EPS}
    if len(homes) != 1:
        raise ValueError("not a machine of pieces")
    number, order = {}, list(homes)
    for s in order:                                         # home is 0; grows while it is read
        number[s] = len(number)
        order += [n for i, _, _, n in machine.arcs[s] if i != EPS and n not in number and n not in homes]
    next_, piece = np.zeros((len(order), 256), np.int32), np.full(len(order), -1, np.int32)
    for s in order:
        for i, o, _, n in machine.arcs[s]:
            if i != EPS:
                next_[number[s], i] = number[n]
            elif o != EPS:
                piece[number[s]] = o
    return Tables(next_, piece), len(machine.arcs)


@lru_cache(maxsize=2)
def composed(vocabulary: V.Vocabulary, weights: tuple[float, ...]) -> tuple[Tables, int]:
    """Once per Python worker."""
    return tables(compose(normaliser(), piece_machine(vocabulary, np.array(weights))))


class Transducer:
    """Normaliser, pieces and byte fallback, composed from a vocabulary."""

    def __init__(self, vocabulary: V.Vocabulary):
        self.vocabulary = vocabulary
        self.surface = surfaces(vocabulary)             # what each id stands for, with spaces for marks
        self.weights = -np.array(initial_weights(vocabulary))
        self.weights[list(vocabulary.byte_ids)] = self.weights.max() + 1.0
        self.tables, self.states = composed(vocabulary, tuple(self.weights.tolist()))
        self.fallback = np.zeros(len(self.weights), bool)
        self.fallback[list(vocabulary.byte_ids)] = True
        inner = set().union(*vocabulary.pieces)
        alone = re.escape(bytes(b for b in range(128) if b not in inner and b != 32))
        # chunks: a byte that no piece holds; spaces and what follows them
        self.chunks = re.compile(b"[" + alone + b"]| *[^ " + alone + b"]+| +", re.DOTALL)
        self.cache: dict[bytes, bytes] = {}

    @cached_property
    def trie(self) -> PieceTrie:
        """The plain trie of the vocabulary: a kilobyte a state beside the composed tables, so made only for who asks."""
        return compiled(self.vocabulary)

    def shortest(self, chunks: list[bytes]) -> list[bytes]:
        """Ids (packed 32-bit integers) on the lightest path that reads each chunk (spaces stand for marks)."""
        out: list = [None] * len(chunks)
        for at, mat in by_length(chunks):
            n, length = mat.shape
            if length > LONG:
                for k, row in zip(at, mat, strict=True):
                    out[k] = self._shortest_long(row.tobytes())
                continue
            cost = np.full((length + 1, n), np.inf)
            cost[0] = 0.0
            came = np.zeros((length + 1, n), np.int32)
            wrote = np.zeros((length + 1, n), np.int32)
            for i, here in self.tables.arcs(mat):
                for j, rows, piece in here:
                    x = cost[i, rows] + self.weights[piece]
                    better = x < cost[j, rows]
                    rows = rows[better]
                    cost[j, rows] = x[better]
                    came[j, rows] = i
                    wrote[j, rows] = piece[better]
            node, every, steps = np.full(n, length), np.arange(n), []
            while node.any():
                steps.append(np.where(node > 0, wrote[node, every], -1))
                node = came[node, every]
            path = np.array(steps[::-1], np.int32).T.reshape(n, -1)
            taken = (path >= 0).sum(axis=1)
            for k, p, m in zip(at, path, taken, strict=True):
                out[k] = p[len(p) - m:].tobytes()
        return out

    def _shortest_long(self, chunk: bytes) -> bytes:
        """The same for one long chunk: 16 bytes a byte."""
        n, weight = len(chunk), self.weights.tolist()
        cost = array("d", [0.0]) + array("d", [math.inf]) * n
        came, wrote = array("i", bytes(4 * (n + 1))), array("i", bytes(4 * (n + 1)))
        for i in range(n):
            for j, piece in self.tables.ways(chunk, i):
                x = cost[i] + weight[piece]
                if x < cost[j]:
                    cost[j], came[j], wrote[j] = x, i, piece
        path = array("i")
        while n:
            path.append(wrote[n])
            n = came[n]
        path.reverse()
        return path.tobytes()

    def encode(self, texts: list[bytes]) -> list[array]:
        """Ids of each text; chunks that are not yet known are composed together."""
        if len(self.cache) >= CACHE:
            self.cache.clear()
        known, out, open_ = self.cache.get, [], []
        for t in texts:
            chunks = self.chunks.findall(b" " + t)
            ids = [known(c) for c in chunks]
            out.append(ids)
            if None in ids:
                open_.append((ids, chunks))
        new = list({c for ids, chunks in open_ for c, i in zip(chunks, ids, strict=True) if i is None})
        found = dict(zip(new, self.shortest(new), strict=True))
        for ids, chunks in open_:
            ids[:] = [found[c] if i is None else i for c, i in zip(chunks, ids, strict=True)]
        self.cache.update((c, i) for c, i in found.items() if len(c) <= LONG)
        return [array("i", b"".join(ids)) for ids in out]

    def decode(self, ids) -> bytes:
        """The text of ``ids``: surfaces joined, the added mark taken off."""
        s = b"".join(map(self.surface.__getitem__, ids))
        return s[1:] if s[:1] == b" " else s


def _id_lists(parts: list[array]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    offsets[1:] = np.cumsum([len(p) for p in parts])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _encode_pass(shared, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = None
        for b in batches:
            fst = fst or Transducer(shared.value)
            lengths = pc.fill_null(pc.binary_length(b.column("_text")), 0).to_pylist()
            for start, stop in T.spans(lengths, BATCH_BYTES):             # only the texts of a span become Python objects
                some = [t or b"" for t in b.column("_text").slice(start, stop - start).to_pylist()]
                parts = fst.encode(some)
                lists = _id_lists(parts)
                marks = np.r_[0, np.cumsum(fst.fallback[lists.values.to_numpy()])]
                ends = lists.offsets.to_numpy()
                cols = [*b.slice(start, stop - start).columns[:-1], lists, pa.array(marks[ends[1:]] - marks[ends[:-1]], pa.int64())]
                names = [*b.schema.names[:-1], "ids", "n_fallback"]
                if decode:
                    cols.append(pa.array([fst.decode(p) == t for p, t in zip(parts, some, strict=True)], pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def _ddl(df: DataFrame, cols: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{c}` {kinds[c]}, " for c in cols)


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = V.DEFAULT_MODEL,
           check: bool = False) -> DataFrame:
    """``keep`` columns plus ``ids array<int>, n_fallback long`` (and ``round_trip`` with ``check``)."""
    keep = [c for c in docs.columns if c not in {"ids", "n_fallback", "round_trip", "_text"}] if keep is None else keep
    src = docs.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(V.load(model))      # one fixed vocabulary, about 1 MB
    ddl = _ddl(src, keep) + "ids array<int>, n_fallback long" + (", round_trip boolean" if check else "")
    return src.mapInArrow(_encode_pass(shared, check), ddl)


def _decode_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = None
        for b in batches:
            fst = fst or Transducer(shared.value)
            texts = [None if ids is None else fst.decode(ids).decode("utf-8", "replace") for ids in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "decoded"])
    return run


def decode(encoded: DataFrame, ids_col: str = "ids", keep: list[str] | None = None, model: str = V.DEFAULT_MODEL) -> DataFrame:
    """``keep`` columns plus ``decoded string``."""
    keep = [c for c in encoded.columns if c not in {ids_col, "decoded", "_ids"}] if keep is None else keep
    src = encoded.select(*keep, F.col(ids_col).alias("_ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(V.load(model))
    return src.mapInArrow(_decode_pass(shared), _ddl(src, keep) + "decoded string")
