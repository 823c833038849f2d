import random

from gazette.llm import jaccard_join as J

from helpers import edge_rows, frame, near_components

SF = "/root/testdata/sf0.001"


def check(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").coalesce(3)
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.components(df).collect()), key=key)
    want = sorted(((i, *w) for (i, _), w in zip(rows, near_components(rows), strict=True)), key=key)
    assert got == want


def test_given_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_one_large_group_of_near_copies(spark):
    """Copies of a few bases with up to 14 % changed words: links on both sides of the bound, many not through a centre."""
    rng = random.Random(7)
    rows = []
    for b in range(3):
        base = [f"b{b}w{i}" for i in range(rng.randrange(60, 200))]
        for k in range(70):
            w = list(base)
            for _ in range(rng.randrange(0, len(w) // 7)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(5 if k % 2 else 10**6)}"
            if k % 5 == 0:
                w = w[:rng.randrange(len(w) // 2, len(w))]
            rows.append((rng.randrange(10**6), " ".join(w)))
    rows += [(10**7 + i, f"a common passage of words shared by very many texts number {i} only") for i in range(40)]
    check(spark, rows)


def test_edges(spark):
    rows = edge_rows() + [(30, "One TWO", "en", "s", 1), (31, "a b c d", "en", "s", 1), (32, "a b c d e", "en", "s", 1)]
    out = J.components(frame(spark, rows).coalesce(1)).collect()
    want = near_components([(r[0], r[1]) for r in rows])
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == sorted(
        (str(r[0]), w[0], str(w[1])) for r, w in zip(rows, want, strict=True))
    assert J.components(frame(spark, rows).limit(0)).count() == 0
    assert J.components(frame(spark, [(1, None, None, None, None)])).collect()[0].component_id == 1


def test_words_are_hashed_some_texts_at_a_time(monkeypatch):
    """Shingles do not depend on how many texts are hashed together, and no more than ``HASHED`` bytes are."""
    import numpy as np

    from gazette.llm import textops as T
    texts = [b"", b"one two", b"a b c d e f " * 30, b" \n", b"x" * 400, b"tail of five or six words"]
    want, seen, hashed = T.shingles(texts), [], T.word_hashes
    monkeypatch.setattr(T, "HASHED", 300)
    monkeypatch.setattr(T, "word_hashes", lambda some: (seen.append(sum(map(len, some))), hashed(some))[1])
    got = T.shingles(texts)
    assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert len(seen) > 1 and max(seen) <= 400
    assert [texts[a:b] for a, b in T.spans([len(t) for t in texts], 300)] == [part for _, part in T.slabs(texts, 300)]
