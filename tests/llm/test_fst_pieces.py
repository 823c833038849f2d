import random

import pytest
import sentencepiece

from gazette.llm import fst_pieces as P
from gazette.llm import vocab as V

from helpers import edge_rows, frame


@pytest.fixture(scope="module")
def fst():
    return P.Transducer(V.load())


def lightest(fst, chunk):
    pieces = {s: i for i, s in enumerate(fst.trie.surface) if fst.trie.used[i]}
    best = {0: (0.0, [])}
    for j in range(1, len(chunk) + 1):
        ways = [(best[i][0] + fst.weights[pieces[chunk[i:j]]], best[i][1] + [pieces[chunk[i:j]]])
                for i in range(max(0, j - 64), j) if chunk[i:j] in pieces and i in best]
        if ways:
            best[j] = min(ways, key=lambda w: w[0])
    return best[len(chunk)]


def test_shortest_path_equals_brute_force(fst):
    rng = random.Random(3)
    chunks = [b" the", b"   indent", "größer".encode(), "日本語".encode(), b"\n", b"  "]
    chunks += [b" " + bytes(rng.choice(b"abcdethin.,") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    import numpy as np
    for c, got in zip(chunks, fst.shortest(chunks), strict=True):
        ids = np.frombuffer(got, np.int32).tolist()
        assert b"".join(fst.surface[i] for i in ids) == c
        assert abs(sum(fst.weights[i] for i in ids) - lightest(fst, c)[0]) < 1e-9


def test_chunks_do_not_change_the_path(fst):
    for t in (b"one two  three", "ein größeres Haus\n\nund  mehr ".encode(), b"a\x00b\tc"):
        ids = list(fst.encode([t])[0])
        assert abs(sum(fst.weights[i] for i in ids) - lightest(fst, b" " + t)[0]) < 1e-9


def test_round_trip_and_library_decoding(fst):
    sp = sentencepiece.SentencePieceProcessor(model_file=V.DEFAULT_MODEL)
    texts = ["", " ", "plain text here", "  two  spaces ", "ümläut 日本語 😀", "tab\tnew\nline", "don't <unk> </s> <0x41>"]
    for t, ids in zip(texts, fst.encode([t.encode() for t in texts]), strict=True):
        assert fst.decode(ids).decode() == t and sp.decode(list(ids)) == t
    hard = ["▁", "a▁b ▁", "\x00\x7f", "".join(map(chr, range(1, 300)))]
    for t, ids in zip(hard, fst.encode([t.encode() for t in hard]), strict=True):
        assert fst.decode(ids).decode() == t


def test_edges(spark):
    docs = frame(spark, edge_rows())
    out = P.encode(docs, keep=["doc_id", "text"], check=True)
    rows = out.collect()
    assert len(rows) == len(edge_rows()) and all(r.round_trip for r in rows)
    back = P.decode(out, keep=["text"]).collect()
    assert all(r.decoded == (r["text"] or "") for r in back)
    assert P.encode(docs.limit(0), check=True).count() == 0


def test_composition_reads_what_the_normaliser_writes():
    """Composed by hand on a tiny vocabulary: all paths of both machines against those of their composition."""
    n = P.normaliser()
    pieces = P.Fst([[(P.MARK, P.EPS, 0.0, 1), (97, P.EPS, 0.0, 2)], [(P.EPS, 7, 1.5, 0), (97, P.EPS, 0.0, 3)], [(P.EPS, 8, 2.0, 0)],
                    [(P.EPS, 9, 0.5, 0)]], {0})
    both = P.compose(n, pieces)

    def paths(machine, text, state=0, eps=0):
        """(outputs, weight) of all paths that read the text."""
        out = [((), 0.0)] if not text and state in machine.final else []
        for i, o, w, to in machine.arcs[state]:
            if i == P.EPS and eps < 4:
                rest = paths(machine, text, to, eps + 1)
            elif text and i == text[0]:
                rest = paths(machine, text[1:], to)
            else:
                continue
            out += [((() if o == P.EPS else (o,)) + x, w + v) for x, v in rest]
        return out
    for text in (b"", b"a", b" ", b"a a", b"aa"):
        want = [(ids, w + v) for middle, w in paths(n, text) for ids, v in paths(pieces, middle)]
        assert sorted(paths(both, text)) == sorted(want) and want


def test_composed_tables_are_the_trie(fst):
    assert (fst.tables.piece >= 0).sum() == (fst.trie.piece >= 0).sum() and fst.states > 30_000
    for s in (b" the", "größer".encode(), "▁x".encode(), b"\x00\xff  q"):
        for i in range(len(s)):
            assert fst.tables.ways(s, i) == fst.trie.ways(s, i)


def test_long_strings_one_by_one(fst, monkeypatch):
    rng = random.Random(8)
    chunks = [b" " + bytes(rng.choice(b"abcdethin.,") for _ in range(n)) for n in (5, 60, 300)]
    together = fst.shortest(chunks)
    monkeypatch.setattr(P, "LONG", 2)
    assert fst.shortest(chunks) == together


def test_four_megabytes_without_a_space(spark):
    """A base64-like string is one chunk: encoded and decoded whole, memory in proportion to it."""
    rng = random.Random(1)
    text = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=4_000_000))
    out = P.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=["doc_id"], check=True)
    row = out.select("round_trip", "n_fallback", "ids").collect()[0]
    assert row.round_trip and row.n_fallback == 0 and len(row.ids) < 4_000_000


def test_a_worker_holds_one_set_of_tables_and_a_span_of_texts(monkeypatch):
    """The plain trie is not made for encoding, and a batch's texts become Python objects span by span."""
    import pyarrow as pa
    P.compiled.cache_clear()
    texts = ["some words of a text " * 20] * 7 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([None if t is None else t.encode() for t in texts])], ["doc_id", "_text"])
    seen = []
    encode = P.Transducer.encode
    monkeypatch.setattr(P.Transducer, "encode", lambda self, some: seen.append(len(some)) or encode(self, some))
    monkeypatch.setattr(P, "BATCH_BYTES", 1000)
    shared = type("Shared", (), {"value": V.load()})
    out = pa.Table.from_batches(P._encode_pass(shared, True)(iter([batch]))).to_pydict()
    assert seen == [2, 2, 2, 3] and out["doc_id"] == list(range(9)) and all(out["round_trip"])
    assert out["ids"][0] == out["ids"][6] and out["ids"][7] == out["ids"][8]
    assert P.compiled.cache_info().currsize == 0
