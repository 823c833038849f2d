import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gazette.llm import token_align as A

from helpers import edge_rows, frame

SF = "/root/testdata/sf0.001"
PAIR = A.Pair()


@pytest.fixture(scope="module")
def libs():
    t = Tokenizer.from_file(PAIR.byte_level)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=PAIR.pieces)


def brute(rows, libs):
    """The result of every (id, text) row by sets of ends and dictionaries of links."""
    tok, sp = libs
    byte = A.byte_alphabet()
    docs = []
    for _, text in rows:
        a = b = []
        if text:
            e = tok.encode(" " + text, add_special_tokens=False)
            a = list(zip(e.ids, [bytes(byte[c] for c in t) for t in e.tokens], strict=True))
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
                 for i in sp.encode(text)]
            raw = (" " + text).encode()
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a = b = []
        ends = lambda side: [sum(len(x) for _, x in side[:k + 1]) for k in range(len(side))] if len(side) < 400 else np.cumsum([len(x) for _, x in side]).tolist()
        ea, eb = ends(a), ends(b)
        cuts = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for c in cuts:
            i2, j2 = ea.index(c, i) + 1, eb.index(c, j) + 1
            groups.append(([x for x, _ in a[i:i2]], [x for x, _ in b[j:j2]]))
            i, j = i2, j2
        docs.append((a, b, groups))
    count = Counter()
    for _, _, groups in docs:
        count.update({(x, y) for g, h in groups for x in g for y in h})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (doc, _), (a, b, groups) in zip(rows, docs, strict=True):
        links = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


ends = st.lists(st.integers(1, 4), min_size=1, max_size=40)


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.integers(1, 17))
def test_merge_path_finds_all_common_ends(x, y, width):
    a, b = np.cumsum(x), np.cumsum(y)
    i, j = A.diagonals(a, b, width)
    merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    for d, p, q in zip([*range(0, len(merged), width), len(merged)], i, j, strict=True):
        assert (p, q) == (sum(s == 0 for _, s in merged[:d]), sum(s == 1 for _, s in merged[:d]))
    x, y = A.common_ends(a, b, width)
    assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_words_one_by_one_are_the_librarys_tokens(libs):
    r = random.Random(3)
    both = A.sides(PAIR)
    bits = ["'s", " ", "  ", "\n", "word", "Ünï", "日本", "12", "!!", "😀", "<|endoftext|>", "\x00", "don't", "e" * 70, "▁", "<0x41>", "\t"]
    texts = ["".join(r.choice(bits) for _ in range(40)) for _ in range(150)] + ["", " ", "   ", "a ", " a  b   ", "x" * 5000]
    for side, want in ((both.encode_a(texts), [libs[0].encode(" " + t, add_special_tokens=False).ids for t in texts]),
                       (both.encode_b([t or " " for t in texts]), [libs[1].encode(t or " ") for t in texts])):
        parts = np.split(side[0], np.cumsum(side[1])[:-1])
        assert [p.tolist() for p in parts] == want
    assert both.ranks is not None
    both.ranks, kept = None, both.ranks                                  # by the listed merges instead
    other = both.encode_a(texts)
    both.ranks = kept
    assert all((x == y).all() for x, y in zip(other, both.encode_a(texts), strict=True))


def test_given_documents(spark, libs):
    from gazette.llm.registry import op12_token_align
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs, libs)
    assert got(op12_token_align(spark, SF)) == want
    part = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(A.audit(part, common=50, width=37)) == want          # most pairs joined by a shuffle, small pieces
    assert sum(r[4] for r in want) > 10_000


def test_edges(spark, libs, monkeypatch):
    rows = [*edge_rows(), (20, "a▁b", None, None, 3), (21, " lead", "en", None, 4), (22, "<|endoftext|><s></s>", None, None, 1)]
    df = frame(spark, rows)
    want = brute([r[:2] for r in rows], libs)
    assert got(A.audit(df)) == want
    assert [r for r in want if r[0] == 20] == [(20, 0, 0, 0, 0, 0, 0, "")]
    out = A.audit(df, keep=["doc_id", "n_chars"], common=3)
    assert got(out) == want and out.columns == ["doc_id", "n_chars", *COLS[1:]]
    assert A.audit(df.limit(0)).count() == 0


def test_tokens_and_groups_as_arrays(spark, libs):
    rows = [(1, "A tokenizer's text"), (2, ""), (3, None), (4, "größer 日本")]
    out = {r.doc_id: r for r in A.unpack(A.align(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        r = out[i]
        assert list(r.a_ids) == (libs[0].encode(" " + t, add_special_tokens=False).ids if t else [])
        assert list(r.b_ids) == (libs[1].encode(t) if t else [])
        assert sum(r.a_sizes) == len(r.a_ids) and sum(r.b_sizes) == len(r.b_ids) and len(r.a_sizes) == len(r.b_sizes)


def test_wide_groups_and_small_blocks(monkeypatch):
    r = np.random.default_rng(1)
    p, q = np.array([3, 50, 1, 7]), np.array([2, 60, 9, 1])
    s = A._Slab(r.integers(0, 9, p.sum()), r.integers(0, 7, q.sum()), p, q, np.array([0, 0, 1, 1]), np.array([53, 8]),
                np.array([62, 10]), np.array([2, 2]))
    want = Counter()
    a = b = 0
    for x, y, d in zip(p, q, s.doc, strict=True):
        want.update(int(d * 1000 + i * 10 + j) for i in s.a[a:a + x] for j in s.b[b:b + y])
        a, b = a + x, b + y
    for block, wide in ((1 << 20, 1 << 20), (5, 10), (100, 0)):
        monkeypatch.setattr(A, "BLOCK", block)
        monkeypatch.setattr(A, "WIDE", wide)
        k, n = A.link_keys(s, 10, 1000)
        assert dict(zip(k.tolist(), n.tolist(), strict=True)) == want


def test_counts_emitted_in_parts(spark):
    aligned = A.align(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = lambda h: sorted(map(tuple, A.link_counts(aligned, hold=h).collect()))
    assert rows(64) == rows(1 << 21)
