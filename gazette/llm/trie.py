"""A byte trie of vocabulary pieces as numpy tables, walked for many strings at once.

Spaces in the strings stand for the vocabulary's marks. A byte without a
one-byte piece has its byte piece, so each string has at least one path.
Strings of up to ``LONG`` bytes are walked together, those of one length in one
matrix; longer ones one by one. The arcs of a start are made when
they are needed and not kept, so memory is that of the strings.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np

from gazette.llm import vocab as V

SLAB = 1 << 20          # string bytes handled at once
LONG = 2048             # bytes from which a string is walked by itself


class Tables:
    """``next[state, byte]`` (0: no way on) and ``piece[state]``, the piece that ends there (-1: none)."""

    def __init__(self, next_: np.ndarray, piece: np.ndarray):
        self.next, self.piece = next_, piece
        self._kids: list[dict[int, int]] | None = None

    def arcs(self, mat: np.ndarray, backward: bool = False):
        """``(start, [(end, rows, pieces)])`` for each start over strings of one length (rows of ``mat``)."""
        n, length = mat.shape
        cols = np.ascontiguousarray(mat.T)
        for i in reversed(range(length)) if backward else range(length):
            here = []
            rows, state = np.arange(n), np.zeros(n, np.int32)
            for j in range(i, length):
                state = self.next[state, cols[j, rows]]
                live = state > 0
                if not live.all():
                    rows, state = rows[live], state[live]
                    if not len(rows):
                        break
                piece = self.piece[state]
                hit = piece >= 0
                if hit.all():
                    here.append((j + 1, rows, piece))
                elif hit.any():
                    here.append((j + 1, rows[hit], piece[hit]))
            yield i, here

    def ways(self, s: bytes, i: int) -> list[tuple[int, int]]:
        """``(end, piece)`` of all pieces that start at ``i`` of one long string."""
        if self._kids is None:
            self._kids = [{} for _ in range(len(self.piece))]
            for state, byte in zip(*np.nonzero(self.next), strict=True):
                self._kids[state][int(byte)] = int(self.next[state, byte])
            self._pieces = self.piece.tolist()
        kids, pieces, state, out = self._kids, self._pieces, 0, []
        for j in range(i, len(s)):
            state = kids[state].get(s[j])
            if state is None:
                break
            if pieces[state] >= 0:
                out.append((j + 1, pieces[state]))
        return out


def surfaces(vocabulary: V.Vocabulary) -> list[bytes]:
    """What each id stands for, with spaces for marks."""
    surface = [p.replace(V.MARK_BYTES, b" ") for p in vocabulary.pieces]
    for p in surface:
        if b" " in p.lstrip(b" "):
            raise ValueError("a piece has a mark after another character")
    for b, i in enumerate(vocabulary.byte_ids):
        surface[i] = bytes([b])
    return surface


class PieceTrie(Tables):
    def __init__(self, vocabulary: V.Vocabulary):
        self.surface = surfaces(vocabulary)
        normal = {p: i for i, p in enumerate(self.surface) if vocabulary.pieces[i]}
        for b, i in enumerate(vocabulary.byte_ids):
            if b != 32:                                  # a space is always a mark
                normal.setdefault(bytes([b]), i)
        states: dict[bytes, int] = {b"": 0}
        edges = []
        for p in normal:
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    edges.append((states[p[:k - 1]], p[k - 1], states[p[:k]]))
        next_ = np.zeros((len(states), 256), np.int32)          # the root has no way in
        s, b, t = np.array(edges).T
        next_[s, b] = t
        piece = np.full(len(states), -1, np.int32)
        for p, i in normal.items():
            piece[states[p]] = i
        super().__init__(next_, piece)
        self.head = np.array([p[:1] == b" " for p in self.surface])
        self.used = np.zeros(len(self.surface), bool)
        self.used[list(normal.values())] = True


@lru_cache(maxsize=2)
def compiled(vocabulary: V.Vocabulary) -> PieceTrie:
    """Once per Python worker."""
    return PieceTrie(vocabulary)


def by_length(strings: list[bytes]):
    """``(places, matrix)`` of strings of one length, at most about SLAB bytes each."""
    groups = defaultdict(list)
    for k, s in enumerate(strings):
        groups[len(s)].append(k)
    for length, places in groups.items():
        step = max(1, SLAB // max(1, length))
        for a in range(0, len(places), step):
            some = places[a:a + step]
            yield some, np.frombuffer(b"".join([strings[k] for k in some]), np.uint8).reshape(len(some), length)
