"""An Aho-Corasick automaton in numpy arrays, run over many texts at a time.

Entries and texts are UTF-8 bytes (a substring of characters is a substring of
bytes). The trie is built level by level over all entries at once; failure
links are then folded into one dense transition table, so a step is a single
gather. Texts are cut into lanes that overlap by the longest entry, and all lanes
advance together: one array operation moves every lane by one byte, however
long or uneven the texts are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LANE = 1024              # bytes of a lane without its overlap, at least
EVENTS = 1 << 20         # matches held before repeated ones are dropped


class Automaton:
    """``entries`` (distinct, not empty); ``find`` tells which of them each text contains."""

    slab = 16_000_000        # bytes of text to search at a time

    def __init__(self, entries: Sequence[bytes]):
        self.size = len(entries)
        self.longest = max(map(len, entries), default=0)
        raw = np.frombuffer(b"".join(entries), np.uint8)
        length = np.array([len(e) for e in entries], np.int64)
        first = np.cumsum(length) - length
        used = np.unique(raw)
        self.klass = np.zeros(256, np.int64)               # 0: a byte of no entry
        self.klass[used] = np.arange(1, len(used) + 1)
        c = self.width = len(used) + 1

        # the trie, a level at a time; states are numbered by depth
        state = np.zeros(self.size, np.int64)
        levels, n = [], 1
        for depth in range(self.longest):
            live = np.flatnonzero(length > depth)
            edge, back = np.unique(state[live] * c + self.klass[raw[first[live] + depth]], return_inverse=True)
            levels.append((edge, n + np.arange(len(edge))))
            state[live] = levels[-1][1][back]
            n += len(edge)
        self.states = n
        ends = np.full(n, -1, np.int64)                    # the entry that ends in a state
        ends[state] = np.arange(self.size)

        # failure links, folded into the transitions; chains of states in which a shorter entry ends as well
        move = np.zeros((n, c), np.int32)
        fail = np.zeros(n, np.int64)
        self.shorter = np.zeros(n, np.int64)
        for depth, (edge, child) in enumerate(levels):
            parent, klass = edge // c, edge % c
            if depth:
                fail[child] = move[fail[parent], klass]
            rows = child
            f = fail[rows]
            self.shorter[rows] = np.where(ends[f] >= 0, f, self.shorter[f])
            move[parent, klass] = child
            if depth + 1 < len(levels):                    # a state starts from what its failure state does
                move[rows] = move[f]
        if levels:                                         # the deepest states have no edges of their own
            rows = levels[-1][1]
            move[rows] = move[fail[rows]]
        self.ends = ends
        self.match = (ends >= 0) | (self.shorter > 0)
        self.move = move.ravel()

    @staticmethod
    def cells(entries: Sequence[bytes]) -> int:
        """An upper bound of the transition table's size."""
        return (sum(map(len, entries)) + 1) * (len(set(b"".join(entries))) + 1)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(text, entry)`` of all entries that the texts ``data[offsets[i]:offsets[i + 1]]`` contain, each once."""
        size = np.diff(offsets)
        if not self.size or not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        step = max(LANE, 4 * self.longest)
        lanes = -(-size // step)
        text = np.repeat(np.arange(len(size)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = offsets[text] + number * step
        reach = np.minimum(offsets[text + 1] - start, step + self.longest - 1)
        order = np.argsort(-reach, kind="stable")
        text, start, reach = text[order], start[order], reach[order]
        active = np.searchsorted(-reach, -np.arange(int(reach[0]) if len(reach) else 0), "left")
        state = np.zeros(len(text), np.int64)
        held, found = [], 0
        klass = self.klass[data]
        for t, k in enumerate(active.tolist()):
            s = self.move[state[:k] * self.width + klass[start[:k] + t]]
            state[:k] = s
            hit = np.flatnonzero(self.match[s])
            if len(hit):
                held.append(text[hit] * self.states + s[hit])
                found += len(hit)
                if found > EVENTS:
                    held = [np.unique(np.concatenate(held))]
                    found = len(held[0])
        if not held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        events = np.unique(np.concatenate(held))
        text, s = events // self.states, events % self.states
        out = []
        while len(s):                                      # each state, then the shorter entries that end with it
            own = self.ends[s] >= 0
            out.append(text[own] * self.size + self.ends[s[own]])
            s = self.shorter[s]
            text, s = text[s > 0], s[s > 0]
        pairs = np.unique(np.concatenate(out))
        return pairs // self.size, pairs % self.size
