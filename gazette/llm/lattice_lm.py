"""Language-model scoring by subword lattices.

A word's lattice holds every segmentation into pieces of an existing
vocabulary: a word-initial piece (they carry the vocabulary's mark), then
inner pieces, each followed by stop or go on. The log-space forward recursion
sums all of them, which gives the word's marginal probability; bytes without
a piece use the vocabulary's byte pieces, so every word has one. Piece weights
start from the file's scores (ranks, as a Zipf law) and are re-estimated on
the distinct training words by expectation-maximisation over the same
lattices (forward-backward).

Words seen in training also have an arc of their own. With absolute
discounting (D = n1 / (n1 + 2 n2)) a token has probability
``(c - D) / N + (D V / N) * marginal``; the end has only its own arc. That is
one unigram model; there is one for each of the ``MAX_PARTS`` commonest languages
of the training rows, one for all other languages together (if there are more),
and one for all rows, and the text's marginal probability is the sum over these
parts, weighted by their rows.

Flow: (1) one pass counts words per batch, a grouped sum gives the word table
(word, counts); (2) ``EM_STEPS`` passes over it sum expected piece counts (the
vocabulary bounds what the driver sees); (3) one pass adds each distinct
word's marginal; (4) a second pass over the texts sums the ``HEAD_WORDS``
commonest words locally from a table of fixed bound and sends the other words
of each document to a join with the word table; partial sums are added per
document. Common words never reach the join, so no key of it is hot. The word
table grows with the corpus and is never collected.

Defined results: null text is empty (one token, the end); a null id counts
like the empty string in the split; rows without language train only the
common part; repeated rows each get a row and each count in training; without
any training row the lattice alone scores; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import vocab as V
from gazette.llm.trie import LONG, by_length, compiled
from gazette.session import scratch_path

HEAD_WORDS = 131_072         # words kept in every task's table; each at most HEAD_BYTES long
HEAD_BYTES = 48
EM_STEPS = 2
MAX_PARTS = 8                # languages with a unigram model of their own
COMMON = 0.05                # weight of the model of all rows
STOP = 0.3                   # first guess of the probability that a word ends after a piece
SMOOTH = 0.1                 # pseudo count of every piece
NO_WORD = b" "               # prefix of join keys that no word has
LN10 = math.log(10)


class Lattice:
    """Word lattices over log piece weights; many words of one length at a time."""

    def __init__(self, vocabulary: V.Vocabulary, logp: list[float], stop: float):
        """``logp``: log weights of the pieces; initial and inner pieces are normalised apart."""
        self.trie = compiled(vocabulary)
        self.stop = math.log(stop)
        self.logw = np.full(len(logp), -np.inf)
        weight = np.exp(np.asarray(logp))
        for side, more in ((self.trie.head, 0.0), (~self.trie.head, math.log(1 - stop))):
            own = side & self.trie.used
            self.logw[own] = np.log(weight[own] / weight[own].sum()) + more

    def _forward(self, arcs, n: int, length: int) -> np.ndarray:
        """alpha[j]: log of the summed weight of all paths over the first j bytes (the mark included)."""
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for i, here in arcs:
            for j, rows, piece in here:
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logw[piece])
        return alpha

    def _forward_long(self, s: bytes) -> array:
        """The same for one long string."""
        w = self.logw.tolist()
        alpha = array("d", [-math.inf]) * (len(s) + 1)
        alpha[0] = 0.0
        for i in range(len(s)):
            if alpha[i] > -math.inf:
                for j, piece in self.trie.ways(s, i):
                    alpha[j] = log_add(alpha[j], alpha[i] + w[piece])
        return alpha

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the summed weight of all segmentations of each word."""
        out = np.empty(len(words))
        for at, mat in by_length([b" " + w for w in words]):
            n, length = mat.shape
            if length > LONG:
                for k, row in zip(at, mat, strict=True):
                    out[k] = self._forward_long(row.tobytes())[-1] + self.stop
            else:
                out[at] = self._forward(self.trie.arcs(mat), n, length)[-1] + self.stop
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected number of each piece over the segmentations of the words (forward-backward)."""
        total = np.zeros(len(self.logw))
        for at, mat in by_length([b" " + w for w in words]):
            n, length = mat.shape
            if length > LONG:
                for row in mat:
                    self._expected_long(row.tobytes(), total)
                continue
            arcs = list(self.trie.arcs(mat))               # of at most SLAB bytes, read twice
            alpha = self._forward(arcs, n, length)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            for i, here in reversed(arcs):
                for j, rows, piece in here:
                    x = self.logw[piece] + beta[j, rows]
                    beta[i, rows] = np.logaddexp(beta[i, rows], x)
                    total += np.bincount(piece, np.exp(alpha[i, rows] + x - alpha[-1, rows]), len(total))
        return total

    def _expected_long(self, s: bytes, total: np.ndarray) -> None:
        alpha, w = self._forward_long(s), self.logw.tolist()
        beta = array("d", [-math.inf]) * (len(s) + 1)
        beta[-1] = 0.0
        sums: dict[int, float] = {}
        for i in range(len(s) - 1, -1, -1):
            for j, piece in self.trie.ways(s, i):
                x = w[piece] + beta[j]
                beta[i] = log_add(beta[i], x)
                share = alpha[i] + x - alpha[-1]
                if share > -700.0:
                    sums[piece] = sums.get(piece, 0.0) + math.exp(share)
        for piece, x in sums.items():
            total[piece] += x


def log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII white space; ``bytes`` methods do exactly that."""
    return text.lower().split() if text else []


# ---------------------------------------------------------------- passes (run inside tasks)
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, part, c, n`` per batch: training count and count, by the part (language) of the row."""
    for b in batches:
        counts: dict[tuple[int, bool], Counter] = {}
        for text, part, held in zip(*(b.column(x).to_pylist() for x in ("text", "part", "held")), strict=True):
            counts.setdefault((part, held), Counter()).update(words_of(text))
        for (part, held), words in counts.items():
            keys = list(words)
            for k in range(0, len(keys), 50_000):
                some = keys[k:k + 50_000]
                n = [words[w] for w in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.binary()), pa.array([part] * len(some), pa.int32()),
                    pa.array([0] * len(n) if held else n, pa.int64()), pa.array(n, pa.int64())], ["word", "part", "c", "n"])


def together(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of at least ``rows`` rows: more words of one length for each matrix step."""
    group: list[pa.RecordBatch] = []
    for b in batches:
        group.append(b)
        if sum(x.num_rows for x in group) >= rows:
            yield group
            group = []
    if group:
        yield group


def _expected_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total, words = None, 0.0, 0
        for group in together(batches):
            lattice = lattice or Lattice(*shared.value)
            some = [w for b in group for w in b.column("word").to_pylist()]
            total = total + lattice.expected(some)
            words += len(some)
        if words:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)),
                                              pa.array(np.append(total[some], float(words)))], ["piece", "e"])
    return run


def _marginal_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for group in together(batches):
            lattice = lattice or Lattice(*shared.value)
            lat = lattice.marginals([w for b in group for w in b.column("word").to_pylist()]) / LN10
            at = 0
            for b in group:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lat[at:at + b.num_rows])], [*b.schema.names, "lat"])
                at += b.num_rows
    return run


def _score_pass(shared, parts: int, id_kind: pa.DataType):
    """One row per document with the sums over its common words and its first other word, then one per other word."""
    kinds = [pa.int64(), id_kind, pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * (parts + 1), pa.binary(), pa.int64()]
    names = ["rid", "id", "held_out", "n_tokens", "known", "base", *[f"s{k}" for k in range(parts)], "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, logs = shared.value            # word -> row of logs: known, base, one column per part
        cols: list[list] = [[] for _ in names]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
            for c in cols:
                c.clear()
            return out

        for b in batches:
            for rid, ident, held, text in zip(*(b.column(x).to_pylist() for x in ("rid", "id", "held", "text")), strict=True):
                words = words_of(text)
                at, times, rest = [], [], []
                for w, k in Counter(words).items():
                    i = rows.get(w)
                    if i is None:
                        rest.append((w, k))
                    else:
                        at.append(i)
                        times.append(k)
                known, *sums = (np.array(times, np.float64) @ logs[at]).tolist() if at else [0.0] * (parts + 2)
                first, *rest = rest or [(NO_WORD + str(rid).encode(), 0)]
                for c, v in zip(cols, (rid, ident, held, len(words), round(known), *sums, *first), strict=True):
                    c.append(v)
                if rest:
                    cols[0].extend([rid] * len(rest))
                    for c in cols[1:-2]:
                        c.extend([None] * len(rest))
                    cols[-2].extend([w for w, _ in rest])
                    cols[-1].extend([k for _, k in rest])
                if len(cols[0]) >= 50_000:
                    yield flush()
        if cols[0]:
            yield flush()
    return run


# ---------------------------------------------------------------- operator
def initial_weights(vocabulary: V.Vocabulary) -> list[float]:
    """Zipf weights from the file's scores (minus the rank of a piece; byte pieces come last)."""
    n = len(vocabulary.scores)
    raw = [1.0 / (10.0 + max(0.0, -s)) if p else 1.0 / (10.0 + n) for p, s in
           zip(vocabulary.pieces, vocabulary.scores, strict=True)]
    total = sum(raw)
    return [math.log(x / total) for x in raw]


def fit_lattice(words: DataFrame, vocabulary: V.Vocabulary, em_steps: int):
    """``(vocabulary, log weights, stop)`` re-estimated on the distinct words of ``words``."""
    sc = words.sparkSession.sparkContext
    logp, stop = initial_weights(vocabulary), STOP
    for _ in range(em_steps):
        rows = (words.select("word").mapInArrow(_expected_pass(sc.broadcast((vocabulary, logp, stop))), "piece int, e double")
                .groupBy("piece").agg(F.sum("e").alias("e")).collect())        # at most one row per piece
        got = {r["piece"]: r["e"] for r in rows}
        n_words = got.pop(-1, 0.0)
        if not n_words:
            break
        stop = min(0.99, max(0.01, n_words / sum(got.values())))
        logp = [math.log(got.get(i, 0.0) + SMOOTH) for i in range(len(logp))]
    return vocabulary, logp, stop


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    held_modulus: int = 7, held_remainder: int = 2, model: str = V.DEFAULT_MODEL,
                    em_steps: int = EM_STEPS, head_words: int = HEAD_WORDS) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Rows whose ``crc32(id as text) mod held_modulus`` is ``held_remainder`` are not learned from.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = dict(docs.dtypes)[id_col]
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % held_modulus == held_remainder
    # whole numbers stay numbers: their maximum is kept in a hash aggregate
    id_kind = "long" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    src = docs.select(F.col(id_col).cast(id_kind).alias("id"), held.alias("held"), F.col(lang_col).cast("string").alias("lang"),
                      F.col(text_col).cast("binary").alias("text"))
    langs = src.filter(~F.col("held")).groupBy("lang").agg(F.count("*").alias("n"))
    ends = langs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = langs.filter(F.col("lang").isNotNull())
    top = [(r["lang"], r["n"]) for r in named.orderBy(F.desc("n"), "lang").limit(MAX_PARTS).collect()]
    others = (named.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in top)
    pooled = F.lit(len(top))                               # of the other languages; rows without one have no part
    if others:
        top.append((None, others))
    part = F.when(F.col("lang").isNull(), F.lit(len(top))).otherwise(pooled)
    for k, (lang, _) in enumerate(top):
        if lang is not None:
            part = F.when(F.col("lang") == lang, F.lit(k)).otherwise(part)
    src = src.withColumn("part", part.cast("int"))

    raw = scratch_path(spark, "lm-words")
    (src.select("text", "part", "held").mapInArrow(_count_words, "word binary, part int, c long, n long").groupBy("word")
     .agg(*[F.sum(F.when(F.col("part") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(len(top))],
          F.sum("c").alias("c"), F.sum("n").alias("n")).write.parquet(raw))
    words = spark.read.parquet(raw)
    counts = [f"c{k}" for k in range(len(top))] + ["c"]
    stat = words.agg(*[x for c in counts for x in (
        F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_n"), F.count_if(F.col(c) > 0).alias(f"{c}_v"),
        F.count_if(F.col(c) == 1).alias(f"{c}_1"), F.count_if(F.col(c) == 2).alias(f"{c}_2"))]).first()
    total, types = stat["c_n"] + ends, stat["c_v"] + (ends > 0)
    denominator = total + types + 1.0

    scored = scratch_path(spark, "lm-marginals")
    fitted = fit_lattice(words.filter("c > 0"), V.load(model), em_steps)
    words.mapInArrow(_marginal_pass(sc.broadcast(fitted)),
                     ", ".join(f"{n} {t}" for n, t in words.dtypes) + ", lat double").write.parquet(scored)

    # per part: log10 of a word's probability, and of the end's
    logs, end_logs, weights = [], [], []
    for c, e in zip(counts, [n for _, n in top] + [ends], strict=True):
        n, v = stat[f"{c}_n"] + e, stat[f"{c}_v"] + (e > 0)
        d = min(0.9, max(0.1, stat[f"{c}_1"] / max(1, stat[f"{c}_1"] + 2 * stat[f"{c}_2"])))
        if n:
            new, end = d * v / n, (e - d) / n
        else:
            n, new, end = 1, 0.5, 0.5                     # nothing was learned: the lattice and an even end
        logs.append(F.when(F.col(c) > 0, F.log10((F.col(c) - d) / n + new * F.pow(F.lit(10.0), "lat")))
                    .otherwise(F.col("lat") + math.log10(new)))
        end_logs.append(math.log10(end))
        weights.append(math.log10((1 - COMMON) * e / sum(n for _, n in top)) if c != "c" else math.log10(COMMON if top else 1.0))
    parts = len(counts)
    table = spark.read.parquet(scored).select(
        "word", "n", (F.col("c") > 0).cast("double").alias("_known"), F.log10((F.col("c") + 1) / F.lit(denominator)).alias("_base"),
        *[x.alias(f"_s{k}") for k, x in enumerate(logs)])
    common = table.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(head_words).drop("n").toArrow()
    # at most head_words rows of at most HEAD_BYTES bytes and MAX_PARTS + 3 numbers
    numbers = [common.column(c).to_numpy() for c in common.schema.names if c != "word"]
    head = sc.broadcast(({w: i for i, w in enumerate(common.column("word").to_pylist())},
                         np.stack(numbers, axis=1) if common.num_rows else np.zeros((0, parts + 2))))

    names = [f"s{k}" for k in range(parts)]
    rows = src.select(F.monotonically_increasing_id().alias("rid"), "id", "held", "text").mapInArrow(
        _score_pass(head, parts, pa.int64() if id_kind == "long" else pa.string()), f"rid long, id {id_kind}, held_out boolean, n_tokens long, known long, base double, "
        + ", ".join(f"{x} double" for x in names) + ", word binary, n long")
    got = rows.join(table.drop("n"), "word", "left")
    added = lambda own, other: F.sum(F.coalesce(F.col(own), F.lit(0)) + F.coalesce(F.col("n") * F.col(other), F.lit(0)))
    sums = got.groupBy("rid").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        added("known", "_known").alias("known"), added("base", "_base").alias("base"),
        *[added(x, f"_{x}").alias(x) for x in names])
    total_of = [F.col(x) + F.lit(e + w) for x, e, w in zip(names, end_logs, weights, strict=True)]
    best = F.greatest(*total_of) if parts > 1 else total_of[0]
    mixed = sum((F.pow(F.lit(10.0), x - best) for x in total_of), F.lit(0.0))
    return sums.select(
        F.col("id").cast(kind).alias(id_col), "held_out", (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.round("known").cast("long") + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10((ends + 1) / denominator))).alias("base_score"),
        (best + F.log10(mixed)).alias("score"))
