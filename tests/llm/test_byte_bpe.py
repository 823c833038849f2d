import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gazette.llm import byte_bpe as B

from helpers import edge_rows, frame

SF = "/root/testdata/sf0.01"
RANKS = B.load_ranks(B.DEFAULT_RANKS)
TRUTH = tiktoken.Encoding("own", pat_str=B.default_pattern(), mergeable_ranks=RANKS, special_tokens={})
MERGES = B.Merges.of_ranks(RANKS)
TIGHT = B.Spec(chunk=40, overlap=9)


def truth(text):
    return TRUTH.encode_ordinary(text or "")


def tricky(seed, n):
    r = random.Random(seed)
    bits = ["'", "'r", "re", "'ll", " ", "  ", "\n", "\t \n", "word", "ünï", "日本語", "12", "½", "!!", "😀", "x" * 30, "é", "\x00", "<|endoftext|>"]
    return "".join(r.choice(bits) for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    assert B.encoder(B.Spec()).texts([text])[0].tolist() == truth(text)


@pytest.mark.parametrize("n", [1, 2, 49, 500, 3000])
def test_merges_of_long_pieces(n):
    r = random.Random(n)
    for letters in ("a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(r.choice(letters) for _ in range(n)).encode()
        assert MERGES._heap(word) == truth(word.decode())
        cut = sorted({r.randrange(n) for _ in range(n // 5)})
        words = [word[a:b] for a, b in zip([0, *cut], [*cut, n], strict=True)]
        assert [np.frombuffer(x, np.int32).tolist() for x in MERGES.encode(words)] == [truth(w.decode()) for w in words]


def test_boundaries_that_two_chunks_share_are_boundaries_of_the_text():
    enc = B.encoder(B.Spec())
    for seed in range(60):
        text = tricky(seed, 60)
        real = {0, *enc.ends(text).tolist()}
        before = None
        synced = True
        for c, last, part in B.cut(text, TIGHT):
            _, head, tail = B.boundaries(part, c, last, TIGHT)
            if c:
                common = set(head.tolist()) & set(before.tolist())
                synced = synced and bool(common)
                if synced:
                    assert min(common) in real
            before = tail


def test_stitched_chunks_in_spark(spark):
    rows = [(i, tricky(i, 8 * i)) for i in range(40)] + [(100, "a" * 900), (101, "ab " * 300), (102, " " * 400 + "x"), (103, "'" * 90 + "re" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.ids for r in B.encode(df, spec=TIGHT).collect()}
    assert got == {i: truth(t) for i, t in rows}


def test_unspaced_megabytes(spark):
    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    out = B.decode(B.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert out[0].ids == truth(text) and bytes(out[0].decoded) == text.encode()


def test_query_on_given_documents(spark):
    from gazette.llm.registry import op13_byte_bpe
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op13_byte_bpe(spark, SF).collect()
    assert len(out) == len(docs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in out:
        ids = truth(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))


def test_edges(spark):
    rows = edge_rows()
    for spec in (B.Spec(), TIGHT):
        out = B.decode(B.encode(frame(spark, rows), keep=["doc_id", "n_chars"], spec=spec))
        key = lambda x: (x[0] is not None, x[0] or 0, x[1])
        got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in out.collect()), key=key)
        assert got == sorted(((i, truth(t), (t or "").encode()) for i, t, *_ in rows), key=key)
    empty = B.digest_columns(B.decode(B.encode(frame(spark, rows).limit(0))))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_decode_any_ids(spark):
    df = spark.createDataFrame([(1, [0, 255, 5000]), (2, []), (3, None)], "doc_id long, ids array<int>")
    of = {r: b for b, r in RANKS.items()}
    got = {r.doc_id: bytes(r.decoded) for r in B.decode(df).collect()}
    assert got == {1: of[0] + of[255] + of[5000], 2: b"", 3: b""}
    with pytest.raises(Exception, match="vocabulary"):
        B.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()
