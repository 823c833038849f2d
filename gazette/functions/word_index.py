"""Entries without white space, found in many texts at a time through the distinct words of the texts.

Such an entry lies within a run of bytes that are not ASCII white space. So the
runs of the texts are numbered, and only distinct ones are searched: for every
length of an entry the 64-bit hashes of all windows of that length are looked up
among the sorted hashes of the entries, and what is found is compared byte by
byte. Work is linear in the texts and grows with the logarithm of the entries
and with the number of their lengths; an entry takes its bytes and 16 more.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
COMPARED = 1 << 24           # bytes of windows that are compared at a time
HASHED = 1 << 16             # entries that are hashed at a time


def is_word(entry: bytes) -> bool:
    return not SPACE[np.frombuffer(entry, np.uint8)].any()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


class _Windows:
    """Hashes of the windows of a run of bytes."""

    def __init__(self, raw: np.ndarray):
        self.fold = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + U(1)) * _powers(BASE, len(raw)), out=self.fold[1:])
        self.back = _powers(BASE_INV, len(raw))

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        h = (self.fold[start + length] - self.fold[start]) * self.back[start]
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(32))


class WordIndex:
    """``entries`` (distinct, not empty, ``is_word``); ``find`` tells which of them each text contains."""

    slab = 1 << 22           # bytes of text to search at a time: the windows of its distinct words take 80 times theirs

    def __init__(self, entries: Sequence[bytes] | pa.Array):
        entries = (entries if isinstance(entries, pa.Array) else pa.array(entries, pa.large_binary())).cast(pa.large_binary())
        self.size = len(entries)
        edges = np.frombuffer(entries.buffers()[1], np.int64)[entries.offset:entries.offset + self.size + 1] if self.size else np.zeros(1, np.int64)
        self.raw = np.frombuffer(entries.buffers()[2], np.uint8)[edges[0]:edges[-1]].copy() if self.size else np.empty(0, np.uint8)
        edges = edges - edges[0]
        small = np.uint32 if len(self.raw) < 1 << 32 else np.int64
        self.first, length = edges[:-1].astype(small), np.diff(edges)
        h = np.empty(self.size, np.uint64)
        for lo in range(0, self.size, HASHED):
            own = edges[lo:lo + HASHED + 1]
            h[lo:lo + HASHED] = _Windows(self.raw[own[0]:own[-1]]).hashes(own[:-1] - own[0], np.diff(own))
        order = np.lexsort((h, length)).astype(small)
        sizes, start = np.unique(length[order], return_index=True)
        ends = np.r_[start[1:], self.size]
        self.by_length = [(int(n), h[order[a:b]], order[a:b]) for n, a, b in zip(sizes, start, ends, strict=True)]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(text, entry)`` of all entries that the texts ``data[offsets[i]:offsets[i + 1]]`` contain, each once."""
        none = np.empty(0, np.int64)
        if not self.size or not len(data):
            return none, none
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begin = offsets[:-1][offsets[:-1] < len(data)]
        first[begin] = inside[begin]                       # a word ends with its text
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(np.flatnonzero(first), offsets)))
        edges = np.r_[np.flatnonzero(first[inside]), int(inside.sum())]
        coded = pa.Array.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(edges.astype(np.int64)),
                                                                     pa.py_buffer(data[inside])]).dictionary_encode()
        word, entry = self._in_words(coded.dictionary)
        n_words = max(1, len(coded.dictionary))
        held = _distinct(text * n_words + np.asarray(coded.indices, np.int64))
        text, code = held // n_words, held % n_words
        at = np.searchsorted(word, np.arange(n_words + 1))                  # the entries of each word
        n = np.diff(at)[code]
        place = np.repeat(at[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pairs = _distinct(np.repeat(text, n) * self.size + entry[place])
        return pairs // self.size, pairs % self.size

    def _in_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(word, entry)`` of all entries that distinct words contain, by word."""
        edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        if not len(words) or edges[0] == edges[-1]:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[edges[0]:edges[-1]]
        edges = edges - edges[0]
        owner = np.repeat(np.arange(len(words)), np.diff(edges))
        left = edges[owner + 1] - np.arange(len(raw))                       # bytes from here to the word's end
        windows, start, out = _Windows(raw), np.arange(len(raw)), []
        for length, known, entry in self.by_length:
            start = start[left[start] >= length]
            h = windows.hashes(start, length)
            at = np.searchsorted(known, h)
            open_ = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h)
            s, at, h = start[open_], at[open_], h[open_]
            while len(s):                                                   # all entries with this hash, mostly one
                e = entry[at].astype(np.int64)
                same = self._equal(raw, s, e, length)
                out.append(owner[s[same]] * self.size + e[same])
                at = at + 1
                more = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == h))
                s, at, h = s[more], at[more], h[more]
        pairs = _distinct(np.concatenate(out)) if out else np.empty(0, np.int64)
        return pairs // self.size, pairs % self.size

    def _equal(self, raw: np.ndarray, start: np.ndarray, entry: np.ndarray, length: int) -> np.ndarray:
        out, step, place = np.zeros(len(start), bool), max(1, COMPARED // length), np.arange(length)
        for lo in range(0, len(start), step):
            a, b = start[lo:lo + step, None] + place, self.first[entry[lo:lo + step], None].astype(np.int64) + place
            out[lo:lo + step] = (raw[a] == self.raw[b]).all(axis=1)
        return out
