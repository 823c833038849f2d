"""Small inputs and brute-force versions shared by the tests of the training-data operators."""

import hashlib
import re
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use themselves
CLASH = {c: "x" for c in ["node", "n", "word", "size", "shard", "token", "words", "h", "rid", "id", "slab", "_text", "_id",
                          "stratum", "ids", "kept", "text_crc32", "host", "_leak", "doc", "item", "start", "held", "part"]}


def edge_rows():
    prose = " ".join(f"word{i % 37} tail{i % 11}" for i in range(60))
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, "one two", "en", "a", 7),
        (5, prose, "en", "a", len(prose)), (6, prose, "de", "a", len(prose)), (6, prose, "de", "a", len(prose)),
        (None, prose + " end", "en", None, 1), (8, "x" * 120_000, None, "b", 120_000),
        (9, "ab " * 30_000, "fr", "b", 90_000), (10, "Ünïcödé ▁ piece <0x0A>   \x00 日本語 😀 " * 3, "en", "b", 1),
        (11, prose.upper(), "en", "c", 1),
    ]


def frame(spark, rows, clash=True):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()]) if clash else df


def words(text):
    """Runs without ASCII white space, A-Z lowered."""
    return text.encode().lower().split() if text else []


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_components(rows):
    """``row index -> (set size, smallest id reachable)`` by comparing all sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def cut_repeats(rows, length=100):
    """Kept bytes and removed spans of ``(id, text)`` rows, by a set of all windows seen so far."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), [None] * len(rows)
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = t[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), len(t) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def leak_pairs(docs, items, least=0.75):
    """``(doc, item) -> similarity`` over all item-sized windows, weights by characters."""
    norm = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w, k: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    weight = lambda s: sum(sum(map(len, x)) for x in s)
    out = {}
    for item, text in items:
        want = norm(text)
        k = min(5, len(want))
        if not want:
            continue
        target = grams(want, k)
        for doc, body in docs:
            w = norm(body)
            if not target & grams(w, k):
                continue
            for s in range(-len(want) + k, len(w) - k + 1):
                have = grams(w[max(0, s):s + len(want)], k)
                if have & target:
                    sim = weight(have & target) / weight(have | target)
                    if sim >= least and sim > out.get((doc, item), 0):
                        out[doc, item] = sim
    return out
