"""Byte-pair merging of many pieces at a time (numpy, inside tasks).

A merge table says which two adjacent ids join, in which order (rank) and into
which id. A piece starts as the ids of its bytes; the adjacent pair with the
lowest rank joins first, the leftmost on ties, until none joins. Pieces of like
length lie in one matrix and merge together, one join of each per step; longer
ones use a heap, so n bytes cost n log n.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Sequence

import numpy as np

NONE = np.int32(2**31 - 1)                  # the rank of a pair that does not join
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128)  # bytes of the pieces of one matrix, at most
ROWS = 1 << 14                              # pieces of one matrix


class Merges:
    """``byte_ids[b]``: the id of a byte; ``pairs``: (left id, right id, rank, joined id)."""

    def __init__(self, byte_ids: Sequence[int], pairs: Iterable[tuple[int, int, int, int]], size: int):
        self.size = size
        self.byte_ids = np.array(byte_ids, np.int32)
        p = np.array(list(pairs), np.int64).reshape(-1, 4)
        key = p[:, 0] * size + p[:, 1]
        order = np.argsort(key, kind="stable")
        self.key = np.r_[key[order], np.int64(2**62)]            # a last key that no pair has
        self.rank = np.r_[p[order, 2], NONE].astype(np.int32)
        self.joined = np.r_[p[order, 3], -1].astype(np.int32)
        b = self.byte_ids.astype(np.int64)
        self.first = self._find(np.repeat(b, 256), np.tile(b, 256)).astype(np.int32)     # place of each pair of bytes
        self._dict: dict[int, int] | None = None

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merges:
        """Any two tokens whose joined bytes are a token join; its rank is its id."""
        pairs = [(ranks[t[:i]], ranks[t[i:]], r, r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        return cls([ranks[bytes([b])] for b in range(256)], pairs, max(ranks.values()) + 1)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, the last place if it does not join."""
        key = left * self.size + right
        at = np.searchsorted(self.key[:-1], key)
        return np.where(self.key[at] == key, at, len(self.key) - 1)

    def encode(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The ids of every piece, as the bytes of 32-bit numbers."""
        out = [b""] * len(pieces)
        length = np.array([len(p) for p in pieces], np.int64)
        low = 0
        for width in WIDTHS:
            own = np.flatnonzero((length > low) & (length <= width))
            for lo in range(0, len(own), ROWS):
                part = own[lo:lo + ROWS]
                ids, n = self._matrix([pieces[i] for i in part.tolist()], length[part], width)
                flat = ids[np.arange(width) < n[:, None]].tobytes()
                at = 0
                for i, k in zip(part.tolist(), (n * 4).tolist(), strict=True):
                    out[i] = flat[at:at + k]
                    at += k
            low = width
        for i in np.flatnonzero(length > low).tolist():
            out[i] = np.array(self._heap(pieces[i]), np.int32).tobytes()
        return out

    def _matrix(self, pieces: list[bytes], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(pieces)
        raw = np.zeros((rows, width), np.uint8)
        raw[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_ids[raw]
        inside = np.arange(width - 1) < n[:, None] - 1
        place = np.where(inside, self.first[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]], len(self.key) - 1)
        rank = self.rank[place]
        n = n.copy()
        live = np.arange(rows)
        columns, pair_columns = np.arange(width - 1), np.arange(width - 2)
        while len(live):
            r = rank[live]
            j = r.argmin(axis=1)                               # the leftmost of the lowest
            joins = r[np.arange(len(live)), j] != NONE
            live, j = live[joins], j[joins]
            if not len(live):
                break
            joined = self.joined[place[live, j]]
            row = ids[live]
            row[:, :-1] = np.take_along_axis(row, columns + (columns > j[:, None]), axis=1)
            k = np.arange(len(live))
            row[k, j] = joined
            ids[live] = row
            n[live] -= 1
            if width > 2:                                      # the pairs lose one place; two of them are new
                p = place[live]
                p[:, :-1] = np.take_along_axis(p, pair_columns + (pair_columns >= j[:, None]), axis=1)
                p[:, -1] = len(self.key) - 1
                before = j > 0
                p[k[before], j[before] - 1] = self._find(row[k[before], j[before] - 1].astype(np.int64), joined[before])
                after = j + 1 < n[live]
                p[k[~after], np.minimum(j[~after], width - 2)] = len(self.key) - 1
                p[k[after], j[after]] = self._find(joined[after].astype(np.int64), row[k[after], j[after] + 1])
                place[live] = p
                rank[live] = self.rank[p]
            else:
                rank[live] = NONE
        return ids, n

    def _heap(self, piece: bytes) -> list[int]:
        if self._dict is None:
            self._dict = {k: i for i, k in enumerate(self.key[:-1].tolist())}
        find, rank, size, n = self._dict.get, self.rank, self.size, len(piece)
        ids = array("q", self.byte_ids[np.frombuffer(piece, np.uint8)].tolist())
        after = array("q", range(1, n + 1))                    # start of the next part
        before = array("q", range(-1, n - 1))
        place = array("q", [-1]) * n                           # of the pair that starts here

        def entry(i: int) -> int:
            """Rank and start of the pair at ``i``, -1 if it does not join."""
            j = after[i]
            place[i] = p = find(ids[i] * size + ids[j], -1) if j < n else -1
            return -1 if p < 0 else (int(rank[p]) << 40) | i

        heap = [e for i in range(n - 1) if (e := entry(i)) >= 0]
        heapq.heapify(heap)
        low = (1 << 40) - 1
        while heap:
            top = heapq.heappop(heap)
            i = top & low
            if place[i] < 0 or int(rank[place[i]]) != top >> 40:
                continue                                       # the pair has changed since
            ids[i] = int(self.joined[place[i]])
            j = after[i]
            k = after[i] = after[j]
            place[j] = -1
            if k < n:
                before[k] = i
            if (e := entry(i)) >= 0:
                heapq.heappush(heap, e)
            if (h := before[i]) >= 0 and (e := entry(h)) >= 0:
                heapq.heappush(heap, e)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


class WordCoder:
    """Ids of words with a memory: words that are new to it are merged together."""

    def __init__(self, merges: Merges, whole: dict[bytes, int] | None = None, memory: int = 1 << 18):
        self.merges, self.memory = merges, memory
        self.whole = {t: np.int32(i).tobytes() for t, i in (whole or {}).items()}
        self.known: dict[str, bytes] = {}

    def ids(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """The ids of every list of words. A word that is an entry of ``whole`` is that id without merging."""
        need: set[str] = set()
        for words in texts:
            need.update(words)
        known = self.known
        fresh = [w for w in need if w not in known]
        raw = [w.encode() for w in fresh]
        merge = [b for b in raw if b not in self.whole]
        made = iter(self.merges.encode(merge))
        for w, b in zip(fresh, raw, strict=True):
            known[w] = self.whole.get(b) or next(made)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in texts]
        if len(known) > self.memory:                           # keep what was used last, without long words
            self.known = {w: known[w] for w in need if len(w) <= 64} if len(need) <= self.memory else {}
        return out
