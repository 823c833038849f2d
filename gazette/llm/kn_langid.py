"""Language identification by interpolated Kneser-Ney character models.

One model per language, order ``ORDER``, over lower-cased letters and a space
for every run of other characters. A symbol is an id of 12 bits (the
``MAX_SYMBOLS`` commonest of the sample; others share id 1), so an n-gram is
packed exactly into one integer. For each order the n-grams seen in any
language are one sorted array with a row of log-probabilities per language,
and their contexts another one with the interpolation weights; a text is
scored by binary search, from the longest n-gram down to the first hit. The
language of lowest cross-entropy per symbol wins (ties: the lesser label).

Learning uses a bounded sample: of the ``MAX_LANGS`` commonest values of the
language column (the lesser on ties) at most ``TRAIN_DOCS`` labelled documents
each for the counts and ``CALIBRATION_DOCS`` others for calibration, both
the first by a hash of the id, always whole texts. Counts are summed in
Spark. Calibration fits the sharpness of ``score`` (the winner's share of
``exp(-sharpness * symbols * cross-entropy)``, symbols capped) by log loss and
a rejection bound per language: the ``REJECT`` quantile of the cross-entropy
of calibration documents; ``rejected`` marks texts above it.

Prediction is a narrow job over whole texts, in pieces of ``CHUNK`` symbols.

Defined results: null text or no letter gives ``und``, score 0 and no
rejection; null language is not learned from; without any labelled row every
text is ``und``; repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 4
BITS = 12
MAX_SYMBOLS = (1 << BITS) - 3
TRAIN_DOCS = 600
CALIBRATION_DOCS = 200
REJECT = 0.999
MAX_LANGS = 64               # languages that get a model: the commonest among the labelled rows
CHUNK = 1 << 20
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Table over all code points: is it a letter?"""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters one space; starts and ends with one space."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cp]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]                     # the first non-letter after a letter is kept as a space
    return np.where(is_letter, cp, 32)[keep]


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams ending at each position from n - 1 on; the last symbol is in the low bits."""
    out = ids[n - 1:].astype(np.int64)
    for k in range(1, n):
        out = out | (ids[n - 1 - k:len(ids) - k].astype(np.int64) << (BITS * k))
    return out


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams (as strings of ORDER symbols) per language."""
    total: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            s = symbols(text).tobytes().decode("utf-32-le", "surrogatepass")
            s = " " * (ORDER - 2) + s              # ORDER - 1 spaces before the first letter
            total.setdefault(lang, Counter()).update(s[i:i + ORDER] for i in range(len(s) - ORDER + 1))
    for lang, c in total.items():
        keys = list(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.string()),
                                          pa.array([c[k] for k in keys], pa.int64())], ["lang", "gram", "n"])


class Model:
    """Sorted arrays of every order for all languages."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        seen: Counter = Counter()
        for grams_ in counts.values():
            for g, n in grams_.items():
                seen[g[-1]] += n
        ranked = sorted(seen, key=lambda c: (-seen[c], c))[:MAX_SYMBOLS]
        self.ids = {ord(c): i + 2 for i, c in enumerate(ranked)}     # 1: any other symbol; 0: none
        self.ids.setdefault(32, len(self.ids) + 2)
        size = len(self.ids) + 1
        tables = [self._one(counts[lang], size) for lang in self.langs]
        self.base = -math.log(size)
        self.keys, self.logp, self.ctx, self.lam = [], [], [], []
        for n in range(1, ORDER + 1):
            ctx = np.unique(np.concatenate([t[n - 1][2] for t in tables]))
            lam = np.ones((len(ctx), len(tables)))
            for col, t in enumerate(tables):
                lam[np.searchsorted(ctx, t[n - 1][2]), col] = t[n - 1][3]
            keys = np.unique(np.concatenate([t[n - 1][0] for t in tables]))
            if n == 1:
                low = np.full((len(keys), len(tables)), 1.0 / size)
            else:
                short = keys & ((1 << (BITS * (n - 1))) - 1)
                low = np.exp(self._lookup(short, n - 1))
            p = lam[np.searchsorted(ctx, keys >> BITS)] * low if len(keys) else low
            for col, t in enumerate(tables):
                p[np.searchsorted(keys, t[n - 1][0]), col] += t[n - 1][1]
            self.keys.append(keys)
            self.logp.append(np.log(p))
            self.ctx.append(ctx)
            self.lam.append(np.log(lam))

    def _one(self, counts: dict[str, int], size: int):
        """Per order: n-grams, their discounted share, contexts and their interpolation weights (Kneser-Ney)."""
        sym = {c: self.ids.get(ord(c), 1) for g in counts for c in g}
        table: Counter = Counter()
        for g, n in counts.items():
            key = 0
            for c in g:
                key = key << BITS | sym[c]
            table[key] += n
        keys = np.array(sorted(table), np.int64)
        n = np.array([table[k] for k in keys.tolist()], np.float64)
        out = []
        for order in range(ORDER, 0, -1):
            ones, twos = int((n == 1).sum()), int((n == 2).sum())
            d = ones / (ones + 2 * twos) if ones else 0.5
            d = min(max(d, 0.1), 0.9)
            ctx, at = np.unique(keys >> BITS, return_inverse=True)
            whole = np.bincount(at, n, len(ctx))
            kinds = np.bincount(at, minlength=len(ctx))
            out.append((keys, np.maximum(n - d, 0) / whole[at], ctx, d * kinds / whole))
            # lower order: the number of distinct symbols before it
            short = keys & ((1 << (BITS * (order - 1))) - 1)
            keys, n = np.unique(short, return_counts=True)
            n = n.astype(np.float64)
        return out[::-1]

    def encode(self, cp: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.ones(0x110000, np.int16)
            self._table[list(self.ids)] = list(self.ids.values())
        return self._table[cp]

    def _lookup(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log-probabilities (rows x languages) of packed n-grams of one order."""
        out = np.full((len(keys), len(self.langs)), self.base)
        todo, add = np.arange(len(keys)), np.zeros((len(keys), len(self.langs)))
        for n in range(order, 0, -1):
            if not len(todo):
                break
            k = keys[todo] & ((1 << (BITS * n)) - 1)
            at = np.searchsorted(self.keys[n - 1], k)
            hit = self.keys[n - 1][np.minimum(at, len(self.keys[n - 1]) - 1)] == k
            rows = todo[hit]
            out[rows] = add[rows] + self.logp[n - 1][at[hit]]
            todo, k = todo[~hit], k[~hit] >> BITS
            at = np.minimum(np.searchsorted(self.ctx[n - 1], k), len(self.ctx[n - 1]) - 1)
            known = self.ctx[n - 1][at] == k
            add[todo[known]] += self.lam[n - 1][at[known]]
        out[todo] = add[todo] + self.base
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(cross-entropy per symbol [texts x languages], scored symbols)``; texts without a letter have 0 symbols."""
        total = np.zeros((len(texts), len(self.langs)))
        length = np.zeros(len(texts), np.int64)
        pad = np.full(ORDER - 2, 32, np.uint32)
        held, owners, size = [], [], 0

        def flush():
            nonlocal held, owners, size
            if held:
                keys = np.concatenate(held)
                own = np.concatenate(owners)
                # equal n-grams are looked up once
                logs = self._lookup(keys, ORDER)
                cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                np.add.at(total, own[cuts], np.add.reduceat(logs, cuts, axis=0))
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            cp = symbols(text) if text else None
            if cp is None or len(cp) < 2:
                continue
            ids = self.encode(np.concatenate([pad, cp]))
            length[i] = len(ids) - ORDER + 1
            for a in range(0, length[i], CHUNK):                   # very long texts in pieces
                part = grams(ids[a:a + CHUNK + ORDER - 1], ORDER)
                held.append(part)
                owners.append(np.full(len(part), i))
                size += len(part)
                if size >= CHUNK:
                    flush()
        flush()
        return -total / np.maximum(length, 1)[:, None], length

    def confidence(self, ce: np.ndarray, length: np.ndarray, sharpness: float) -> np.ndarray:
        x = -(ce - ce.min(axis=1, keepdims=True)) * (sharpness * np.minimum(length, 1000))[:, None]
        return 1.0 / np.exp(x).sum(axis=1)


def _predict_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sharpness, bounds = shared.value
        for b in batches:
            ce, length = model.entropies(b.column("_text").to_pylist())
            best = ce.argmin(axis=1)
            score = model.confidence(ce, length, sharpness)
            low = ce[np.arange(len(best)), best]
            none = length == 0
            pred = [("und" if z else model.langs[j]) for j, z in zip(best, none, strict=True)]
            yield pa.RecordBatch.from_arrays([
                *b.columns[:-1], pa.array(pred, pa.string()), pa.array(np.where(none, 0.0, score)),
                pa.array(np.where(none, 0.0, low)), pa.array(~none & (low > bounds[best]))],
                [*b.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"])
    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS, max_langs: int = MAX_LANGS):
    """``(Model, sharpness, rejection bounds)`` from labelled rows, or None without any."""
    lab = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    top = lab.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not top:
        return None
    lab = lab.filter(F.col("lang").isin([r["lang"] for r in top]))
    h = F.xxhash64(F.col("_id").cast("string"), F.lit("langid"))
    w = Window.partitionBy("lang").orderBy("_h", "_id")
    # the first rows of each language by hash: a window limit that each task applies before the shuffle
    pick = (lab.select("lang", "_id", h.alias("_h")).withColumn("_k", F.row_number().over(w))
            .filter(F.col("_k") <= train_docs + calibration_docs).collect())      # bounded per language, and these are bounded
    spark = docs.sparkSession
    if not pick:
        return None
    ids = spark.createDataFrame([(r["_id"], r["lang"], r["_k"]) for r in pick],
                                lab.select("_id", "lang").schema.add("_k", T.IntegerType()))
    sample = lab.join(F.broadcast(ids.dropDuplicates(["_id", "lang"])), ["_id", "lang"])
    counts: dict[str, dict[str, int]] = {}
    for r in (sample.filter(F.col("_k") <= train_docs).select("lang", "text")
              .mapInArrow(_count_pass, "lang string, gram string, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()):     # n-grams of the bounded sample
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    if not counts:
        return None
    model = Model(counts)
    shared = spark.sparkContext.broadcast(model)

    def entropies(batches):
        m = shared.value
        for b in batches:
            ce, length = m.entropies(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(ce.tolist(), pa.list_(pa.float64())),
                                              pa.array(length)], ["lang", "ce", "length"])

    rows = [r for r in sample.filter(F.col("_k") > train_docs).select("lang", "text").mapInArrow(
        entropies, "lang string, ce array<double>, length long").collect() if r["length"] and r["lang"] in counts]
    sharpness, bounds = 1.0, np.full(len(model.langs), np.inf)
    if rows:
        ce = np.array([r["ce"] for r in rows])
        length = np.array([r["length"] for r in rows])
        true = np.array([model.langs.index(r["lang"]) for r in rows])
        right = ce.argmin(axis=1) == true

        def loss(s):
            p = np.clip(model.confidence(ce, length, s), 1e-6, 1 - 1e-6)
            return -np.where(right, np.log(p), np.log(1 - p)).mean()

        sharpness = min((2.0 ** k for k in range(-8, 3)), key=loss)
        for j in range(len(model.langs)):
            own = ce[(true == j) & right, j]
            if len(own) >= 20:
                bounds[j] = np.quantile(own, REJECT) + own.std()
    return model, sharpness, bounds


def predict(docs: DataFrame, fitted, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``lang_pred, score, cross_entropy, rejected``."""
    keep = docs.columns if keep is None else keep
    if fitted is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("cross_entropy"), F.lit(False).alias("rejected"))
    src = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    ddl = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return src.mapInArrow(_predict_pass(docs.sparkSession.sparkContext.broadcast(fitted)),
                          ddl + "lang_pred string, score double, cross_entropy double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             held_modulus: int = 5, held_remainder: int = 0) -> DataFrame:
    """``id, held_out, lang_pred, score, ...`` of every row; learns only from rows that are not held out."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % held_modulus == held_remainder
    src = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fitted = fit(src.filter(~F.col("held_out")), id_col, "text", "lang")
    return predict(src, fitted, "text", [id_col, "held_out"])
