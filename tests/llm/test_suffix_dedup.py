import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gazette.llm import suffix_dedup as S

from helpers import cut_repeats, edge_rows, frame

SF = "/root/testdata/sf0.001"


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").coalesce(2)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                 for r in S.deduplicate(df, **kw).collect())
    want = sorted((i is not None, i or 0, *w[:4]) for (i, _), w in zip(rows, cut_repeats(rows), strict=True))
    assert got == want


@pytest.mark.parametrize("shard", [S.SHARD, 2_000])
def test_given_documents(spark, shard):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows, shard=shard)


@pytest.mark.parametrize("shard", [S.SHARD, 700])
def test_copies_edits_and_periods(spark, shard):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(3)]
    rows = []
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "#"
        a = rng.randrange(200)
        rows.append((rng.randrange(1000) * 100 + i, "".join(t[a:a + rng.randrange(250)])))
    rows += [(200_001, "ab" * 200), (200_002, "ab" * 75), (200_003, "é" * 130), (200_004, "z" * 99), (200_005, "z" * 100)]
    check(spark, rows, shard=shard)


def test_edges(spark):
    rows = edge_rows()
    out = S.deduplicate(frame(spark, rows).coalesce(1), keep=["doc_id", "lang"], with_text=True).collect()
    want = cut_repeats([(r[0], r[1]) for r in rows])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in out) == sorted(
        (str(r[0]), w[0], w[1], w[3]) for r, w in zip(rows, want, strict=True))
    assert S.deduplicate(frame(spark, rows).limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    runs = [bytes(rng.integers(97, 99, rng.integers(100, 200), dtype=np.uint8)) for _ in range(20)]
    runs += [runs[0][:150], runs[1][20:], b"a" * 180]
    raw = np.frombuffer(b"".join(runs), np.uint8)
    sizes = np.array([len(r) for r in runs])
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = S.sorted_windows(raw, begin + np.repeat(sizes, sizes))
    whole = raw.tobytes()
    texts = [whole[i:i + 100] for i in order]
    assert texts == sorted(texts)
    lcp = S.common_prefixes(raw, order, begin)
    for k in range(1, len(texts)):
        same = next((j for j in range(100) if texts[k][j] != texts[k - 1][j]), 100)
        assert lcp[k] == same


def test_merge_by_binary_search_keeps_the_earliest():
    run = lambda *rows: np.array(list(rows), S.WINDOW)
    a = run((5, 1, 7, 70, 0), (9, 1, 7, 70, 5))
    b = run((5, 1, 3, 30, 2), (5, 2, 9, 90, 0), (8, 1, 1, 10, 0))
    got = {(s, bytes(x)) for s, x, *_ in S.merge_runs([a, b])}
    one = np.zeros(1, S.SPAN)
    one["place"], one["a"], one["b"] = 70, 0, 100
    assert got == {(0, one.tobytes())}


def test_slabs_do_not_depend_on_arrow_batches(spark, monkeypatch):
    """The three reads send different columns, so batches limited by bytes end at different rows."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(5)]
    rows = [(i, rng.choice(base)[rng.randrange(100):] + str(i), "k" * 2_000) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string").coalesce(1)
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "20000")
    try:
        got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in S.deduplicate(df, keep=["doc_id", "extra"]).collect())
    finally:
        spark.conf.set(conf, old)
    assert got == [(r[0], w[1], w[3]) for r, w in zip(rows, cut_repeats([r[:2] for r in rows]), strict=True)]


def test_other_rows_are_noticed():
    import pyarrow as pa
    mark = lambda *m: pa.table({"mark": pa.array(m, pa.int64())})
    S._same(mark(None, 5, 5), mark(5))
    S._same(mark(), mark(5))
    for other in (mark(6), mark()):
        with pytest.raises(RuntimeError):
            S._same(mark(None, 5), other)


def test_slab_numbers_and_buckets_at_scale():
    from gazette.llm import textops as T
    last = T.first_slab((1 << 27) - 1) + (1 << T.SLABS_BITS) - 1
    assert (last << 16) | 0xFFFF < 1 << 63 and T.first_slab(32_768) > T.first_slab(32_767) + 1_000_000
    with pytest.raises(ValueError):
        T.first_slab(1 << 27)
    assert T.bucket_count(0, 8) == 64 and T.bucket_count(10**13, 200) * T.BUCKET_BYTES >= 10**13
    assert all(n / T.bucket_count(n, 200) <= T.BUCKET_BYTES for n in (10**9, 10**12, 10**14))


def shard_of(rng, minimisers, copies, length=100):
    """A shard's table: per minimiser that many runs, which share 60 windows."""
    from gazette.llm import textops as T
    text, meta = [], []
    for k in range(minimisers):
        core = rng.integers(97, 123, 60 + length - 1, dtype=np.uint8).tobytes()
        for c in range(copies):
            text.append(rng.integers(97, 123, 29, dtype=np.uint8).tobytes() + bytes([65 + c]) + core)
            piece = T.mix(np.array([k], np.uint64))[0] % np.uint64(S.PIECES)
            meta.append((c, c << 16 | k & 0xFFFF, 0, len(text[-1]) - length + 1, 1, piece))
    return pa.table({"text": pa.array([b"".join(text)], pa.binary()),
                     "meta": pa.array([np.array(meta, S.META).tobytes()], pa.binary())})


def test_a_shard_is_sorted_in_little_memory():
    """A worker took 116 bytes for each of the shard's; two of them took an executor over its memory (pipeline)."""
    table = shard_of(np.random.default_rng(5), 3_500, 3)
    size = len(table.column("text")[0].as_py())
    assert 1_900_000 < size < 2_100_000
    tracemalloc.start()
    try:
        found = S._shard_pass(12, 100)(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30 * size
    spans = {slab: np.frombuffer(x, S.SPAN) for slab, x in zip(found.column("slab").to_pylist(), found.column("spans").to_pylist(), strict=True)}
    assert sorted(spans) == [1, 2]                      # slab 0 has the earliest run of each minimiser
    for s in spans.values():
        assert sorted(s["place"]) == list(range(3_500)) and set(s["a"]) == {30} and set(s["b"]) == {189}


def test_hashes_do_not_depend_on_the_block(monkeypatch):
    raw = np.random.default_rng(7).integers(0, 256, 5_000, dtype=np.uint8)
    whole = S.gram_hashes(raw, 32)
    monkeypatch.setattr(S, "BLOCK", 700)
    assert (S.gram_hashes(raw, 32) == whole).all() and len(whole) == 4_969 and not len(S.gram_hashes(raw[:31], 32))


def test_only_a_slab_of_texts_becomes_python_objects(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)  # noqa: N815
    monkeypatch.setattr(S, "TaskContext", Task)
    monkeypatch.setattr(S, "SLAB", 100_000)
    b = pa.RecordBatch.from_arrays([pa.array([b"x" * 2_000, None] * 2_500, pa.binary())], ["_text"])
    tracemalloc.start()
    try:
        got = [(slab, [p.num_rows for p in pieces], len(texts), sum(map(len, texts))) for slab, pieces, texts in S._slabs(iter([b, b.slice(0, 75)]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2_000_000
    assert got[0] == (0, [100], 100, 100_000) and sum(x[2] for x in got) == 5_075 and got[-1][1] == [75]
    assert [x[0] for x in got] == list(range(51))
