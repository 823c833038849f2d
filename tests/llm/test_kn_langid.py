import zlib

import numpy as np

from gazette.llm import kn_langid as K

from helpers import edge_rows, frame

SF = "/root/testdata/sf0.01"


def counted(text):
    s = " " * (K.ORDER - 2) + K.symbols(text).tobytes().decode("utf-32-le")
    out = {}
    for i in range(len(s) - K.ORDER + 1):
        out[s[i:i + K.ORDER]] = out.get(s[i:i + K.ORDER], 0) + 1
    return out


def test_models_are_distributions():
    m = K.Model({"a": counted("abra cadabra abba cab"), "b": counted("die der das dieb und")})
    rng = np.random.default_rng(0)
    known = sorted(m.ids.values())
    for _ in range(20):
        ctx = rng.choice(known, K.ORDER - 1)
        keys = np.array([int(np.bitwise_or.reduce([int(c) << K.BITS * (K.ORDER - 1 - i) for i, c in enumerate(ctx)])) | s
                         for s in [1, *known]], np.int64)
        total = np.exp(m._lookup(keys, K.ORDER)).sum(axis=0)
        assert np.allclose(total, 1.0, atol=1e-6)


def plain_kneser_ney(counts, size):
    """``p(symbol | context)`` by the textbook recursion over dictionaries."""
    orders = [None] * (K.ORDER + 1)
    orders[K.ORDER] = dict(counts)
    for n in range(K.ORDER - 1, 0, -1):
        shorter = {}
        for g in orders[n + 1]:
            shorter[g[1:]] = shorter.get(g[1:], 0) + 1           # distinct symbols before it
        orders[n] = shorter
    discount, total, kinds = {}, {}, {}
    for n in range(1, K.ORDER + 1):
        ones, twos = (sum(c == k for c in orders[n].values()) for k in (1, 2))
        discount[n] = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
        for g, c in orders[n].items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1

    def p(g):
        n, ctx = len(g), g[:-1]
        low = p(g[1:]) if n > 1 else 1 / size
        if ctx not in total:
            return low
        return max(orders[n].get(g, 0) - discount[n], 0) / total[ctx] + discount[n] * kinds[ctx] / total[ctx] * low
    return p


def test_probabilities_equal_plain_kneser_ney():
    texts = {"a": "abra cadabra abba cab bad dab", "b": "die der das dieb und deren diebe"}
    counts = {k: counted(v) for k, v in texts.items()}
    m = K.Model(counts)
    size = len(m.ids) + 1
    probe = ["".join(g) for v in counts.values() for g in v] + ["abab", " ddd", "bbbb", "dieu", "zzzz", "aza ", "   a"]
    symbol = lambda c: m.ids.get(ord(c), 1)
    keys = np.array([sum(symbol(c) << (K.BITS * (K.ORDER - 1 - i)) for i, c in enumerate(g)) for g in probe], np.int64)
    got = m._lookup(keys, K.ORDER)
    for j, lang in enumerate(m.langs):
        p = plain_kneser_ney({tuple(map(symbol, g)): n for g, n in counts[lang].items()}, size)
        assert np.allclose(got[:, j], [np.log(p(tuple(map(symbol, g)))) for g in probe], atol=1e-9)
    text = "dab die abra"
    ce, length = m.entropies([text])
    s = " " * (K.ORDER - 2) + K.symbols(text).tobytes().decode("utf-32-le")
    grams = [s[i:i + K.ORDER] for i in range(len(s) - K.ORDER + 1)]
    assert length[0] == len(grams)
    for j, lang in enumerate(m.langs):
        p = plain_kneser_ney({tuple(map(symbol, g)): n for g, n in counts[lang].items()}, size)
        assert abs(ce[0, j] + np.mean([np.log(p(tuple(map(symbol, g)))) for g in grams])) < 1e-9


def test_many_language_values_are_bounded(spark):
    rows = [(i, f"some english words number {i} here and there", "en", "s", 1) for i in range(60)]
    rows += [(100 + i, f"einige deutsche wörter nummer {i} hier und dort", "de", "s", 1) for i in range(50)]
    rows += [(1000 + i, f"noise {i}", f"x{i}", "s", 1) for i in range(300)]
    model, _, _ = K.fit(frame(spark, rows, False), max_langs=2)
    assert model.langs == ["de", "en"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = K.identify(docs).collect()
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in out) and np.mean([r.rejected for r in held]) < 0.05


def test_edges(spark):
    rows = edge_rows() + [(40 + i, f"some english words number {i} here and there", "en", "s", 1) for i in range(40)]
    rows += [(100 + i, f"einige deutsche wörter nummer {i} hier und dort", "de", "s", 1) for i in range(40)]
    out = K.identify(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert all(r.lang_pred in {"en", "de", "fr", "und"} and 0 <= r.score <= 1 for r in out)
    assert K.identify(frame(spark, rows).limit(0)).count() == 0
    none = K.identify(frame(spark, [(1, "text", None, None, 4)], False)).collect()
    assert none[0].lang_pred == "und"
    digits = K.identify(frame(spark, [*rows, (900, "123 456", "en", "s", 1)], False)).filter("doc_id = 900").first()
    assert digits.lang_pred == "und"
