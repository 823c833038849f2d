"""Vectorised words, word hashes and word shingles of many texts (numpy, inside tasks).

Words are runs without ASCII white space of the text with A-Z lowered, as UTF-8
bytes. Hashes are 64 bits: a polynomial over the bytes of a word, mixed; a
shingle hashes its five words in order (or, for texts of fewer words, all of
them and their number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
PLACE = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BUCKET_BYTES = 32 << 20      # text bytes whose hashes go to one bucket, about
SLABS_BITS = 20              # slabs of a partition


def bucket_count(text_bytes: int, tasks: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many hash buckets a table of so many text bytes gets: enough for all tasks, and none above its share."""
    return max(64, 2 * tasks, -(-text_bytes // bucket_bytes))


def first_slab(partition: int) -> int:
    """The number of a partition's first slab. Slab and place (16 bits) fit 63 bits for up to 2^27 partitions."""
    if partition >= 1 << 27:
        raise ValueError("too many partitions")
    return partition << SLABS_BITS


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def spans(lengths: list[int], size: int) -> Iterator[tuple[int, int]]:
    """``(first, end)`` of runs of texts of together at most ``size`` bytes (one text at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def slabs(texts: list[bytes], size: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """``(first index, texts)`` of together at most ``size`` bytes (one text at least)."""
    for start, end in spans([len(t) for t in texts], size):
        yield start, texts[start:end]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of every word, first word of each text + end)``."""
    raw = np.frombuffer(b" " + b" ".join([t.lower() for t in texts]) + b" ", np.uint8)
    gap = SPACE[raw]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    n = len(raw)
    fold = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + U(1)) * powers(BASE, n), out=fold[1:])
    h = mix((fold[ends] - fold[starts]) * powers(BASE_INV, n)[starts])
    begin = np.cumsum([1] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(starts, begin)


HASHED = 500_000             # text bytes whose words are hashed at a time: the arrays take some 40 bytes for each


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (empty without words)."""
    return [s for _, some in slabs(texts, HASHED) for s in _shingles(some)]


def _shingles(texts: list[bytes]) -> list[np.ndarray]:
    h, first = word_hashes(texts)
    runs = None
    if len(h) >= SHINGLE:
        runs = sum((h[k:len(h) - SHINGLE + 1 + k] * PLACE[k] for k in range(SHINGLE)), U(0))
        runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= SHINGLE:
            s = np.sort(runs[a:b - SHINGLE + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif n:
            whole = sum((h[a + k:a + k + 1] * PLACE[k] for k in range(n)), U(n))
            out.append(mix(mix(whole)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def pack40(rest: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as five byte planes (the high ones repeat, so they compress)."""
    return b"".join((rest >> U(s)).astype(np.uint8).tobytes() for s in (32, 24, 16, 8, 0))


def unpack40(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(5, -1).astype(np.uint64)
    return sum((p << U(s) for p, s in zip(planes, (32, 24, 16, 8, 0), strict=True)), U(0))
