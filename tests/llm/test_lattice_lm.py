import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gazette.llm import lattice_lm as L
from gazette.llm import vocab as V

from helpers import edge_rows, frame, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lattice():
    v = V.load()
    return L.Lattice(v, L.initial_weights(v), 0.3)


def paths(lattice, word):
    """All segmentations of a word (with its leading mark) as lists of piece ids."""
    pieces = {s: i for i, s in enumerate(lattice.trie.surface) if lattice.trie.used[i]}

    def rest(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            if s[:k] in pieces:
                for r in rest(s[k:]):
                    yield [pieces[s[:k]], *r]

    return list(rest(b" " + word))


@pytest.mark.parametrize("word", [b"the", b"thing", "größe".encode(), b"\x01a", "日本".encode(), "▁a".encode()])
def test_marginal_and_expectation_equal_enumeration(lattice, word):
    every = paths(lattice, word)
    weight = np.array([lattice.logw[p].sum() for p in every])
    total = np.logaddexp.reduce(weight)
    assert math.isclose(lattice.marginals([word])[0], total + lattice.stop, rel_tol=1e-9)
    share = np.exp(weight - total)
    want = np.zeros(len(lattice.logw))
    for p, s in zip(every, share, strict=True):
        np.add.at(want, p, s)
    assert np.allclose(lattice.expected([word]), want)


def test_long_words_one_by_one(lattice, monkeypatch):
    rng = np.random.default_rng(3)
    some = [bytes(rng.choice(list(b"abcdeinrst"), n).astype(np.uint8)) for n in (3, 50, 400)]
    want, counts = lattice.marginals(some), lattice.expected(some)
    monkeypatch.setattr(L, "LONG", 1)
    assert np.allclose(lattice.marginals(some), want, rtol=1e-9) and np.allclose(lattice.expected(some), counts, atol=1e-9)


def test_a_word_of_megabytes(lattice):
    word = bytes(np.random.default_rng(4).choice(list(b"abcdefghijklmnopqrstuvwxyz0123456789+/"), 1_000_000).astype(np.uint8))
    assert -2e7 < lattice.marginals([word])[0] < -1e6


def test_weights_are_probabilities(lattice):
    used, head = lattice.trie.used, lattice.trie.head
    assert math.isclose(np.exp(lattice.logw[used & head]).sum(), 1.0, rel_tol=1e-9)
    assert math.isclose(np.exp(lattice.logw[used & ~head]).sum(), 0.7, rel_tol=1e-9)


@pytest.mark.parametrize("most", [8, 2])
def test_scores_equal_brute_force(spark, most, monkeypatch):
    """With two parts of their own, the other two languages of the data are pooled."""
    monkeypatch.setattr(L, "MAX_PARTS", most)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    parts = Counter(lang for i, _, lang in rows if not held[i])
    own = sorted(parts, key=lambda x: (-parts[x], x))[:most]
    rows = [(i, t, lang if lang in own else "others") for i, t, lang in rows]
    parts = Counter(lang for i, _, lang in rows if not held[i])
    langs = sorted(parts, key=lambda x: (-parts[x], x))
    count = {k: Counter() for k in [*langs, None]}
    for i, t, lang in rows:
        if not held[i]:
            for k in (lang, None):
                count[k].update([*words(t), None])
    vocabulary, logp, stop = L.fit_lattice(spark.createDataFrame([(w,) for w in count[None] if w is not None], "word binary"),
                                           V.load(), 1)
    fitted = L.Lattice(vocabulary, logp, stop)
    every = sorted({w for _, t, _ in rows for w in words(t)})
    lat = dict(zip(every, np.exp(fitted.marginals(every)), strict=True))
    n, v = sum(count[None].values()), len(count[None])

    def part(k, ws):
        c, total = count[k], sum(count[k].values())
        ones, twos = (sum(x == m for w, x in c.items() if w is not None) for m in (1, 2))
        d = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))
        logs = [math.log10((c[w] - d) / total + d * len(c) / total * lat[w]) if c[w] else math.log10(d * len(c) / total * lat[w])
                for w in ws]
        return sum(logs) + math.log10((c[None] - d) / total)

    for head in (1 << 16, 50)[:3 - most // 4]:                           # with few words in the local table most go through the join
        got = {r.doc_id: r for r in L.score_documents(docs, em_steps=1, head_words=head).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows:
            ws = words(t)
            r = got[i]
            base = sum(math.log10((count[None][w] + 1) / (n + v + 1)) for w in [*ws, None])
            each = [part(k, ws) + math.log10(0.95 * parts[k] / sum(parts.values()) if k else 0.05) for k in [*langs, None]]
            score = np.logaddexp.reduce(np.array(each) * L.LN10) / L.LN10
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
                held[i], len(ws) + 1, sum(count[None][w] > 0 for w in [*ws, None]), n)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6)


def test_edges(spark):
    out = L.score_documents(frame(spark, edge_rows()), em_steps=1).collect()
    assert len(out) == len(edge_rows())
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert L.score_documents(frame(spark, edge_rows()).limit(0), em_steps=1).count() == 0
    held_only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    only = L.score_documents(frame(spark, [(i, "some text", "en", "s", 9) for i in held_only], False), em_steps=1).collect()
    assert len(only) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in only)
