import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gazette.llm import divergence as D
from gazette.llm import oracles

from helpers import edge_rows, frame

SF = "/root/testdata/sf0.001"


def brute(rows, min_docs=10, top=10):
    """All results of ``(lang, source, text)`` rows with plain dictionaries and Python integers."""
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        held[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        sources = [s for x, s in counts if x == lang]
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            telling = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(telling)[:top])):
                out += [(lang, s, part, i.decode(), -x, k + 1) for k, (x, i) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def given_rows(spark):
    return [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_given_documents(spark):
    from gazette.llm.registry import op11_source_divergence
    want = brute(given_rows(spark))
    assert got(op11_source_divergence(spark, SF)) == want and len(want) > 300
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    sql = con.execute(oracles.SQL["op11_source_divergence"]).df()
    assert sorted(sql[["lang", "source", "part", "item", "value", "rank"]].itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("kw", [{"hot": 40}, {"cells": 30}, {"hold": 5}, {"term_block": 7, "source_block": 3}])
def test_small_limits_change_nothing(spark, kw):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(D.audit(df, **kw)) == brute(given_rows(spark))


def test_edges(spark):
    rows = edge_rows()
    r = random.Random(2)
    rows += [(100 + i, " ".join(r.choices(["Aa", "bB", "ÀÉ", "c-d", "e\x00f", "日本"], k=r.randrange(9))), r.choice(["en", "", None, "xx"]),
              r.choice(["a", None, "", "z", "ü"]), 0) for i in range(120)]
    for least in (1, 3, 10):
        assert got(D.audit(frame(spark, rows), min_docs=least, top=3)) == brute([(x[2], x[3], x[1]) for x in rows], least, 3)
    assert D.audit(frame(spark, rows).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=12), min_size=1, max_size=300))
def test_perfect_hash_is_minimal_and_verified(keys):
    import pyarrow as pa
    keys = sorted(keys)
    h = D.PerfectHash(keys)
    slots = h.find(pa.array(keys, pa.binary()), D.key_hashes(keys))
    assert sorted(slots.tolist()) == list(range(len(keys))) and [h.keys[int(s)].as_py() for s in slots] == keys
    foreign = [k + b"x" * 13 for k in keys]
    assert (h.find(pa.array(foreign, pa.binary()), D.key_hashes(foreign)) == -1).all()


def test_keys_with_equal_hashes(monkeypatch):
    import pickle

    import pyarrow as pa
    monkeypatch.setattr(D, "key_hashes", lambda keys: np.array([len(k) for k in keys], np.uint64))
    keys = [b"a", b"b", b"cc", b"ddd", b"eee", b"fff"]
    h = pickle.loads(pickle.dumps(D.PerfectHash(keys)))
    probe = [*keys, b"x", b"zz", b"yyy"]
    slots = h.find(pa.array(probe, pa.binary()), D.key_hashes(probe))
    assert sorted(slots[:6].tolist()) == list(range(6)) and slots[6:].tolist() == [-1] * 3
    assert [h.keys[int(s)].as_py() for s in slots[:6]] == keys


def test_hash_is_sparks(spark):
    keys = ["en\0abc", "\0x", "ü\0日本"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    spark_h = [r[0] % (1 << 64) for r in df.orderBy("i").selectExpr("xxhash64(k)").collect()]
    assert spark_h == D.key_hashes([k.encode() for k in keys]).tolist()


def test_exact_shares(spark):
    r = random.Random(1)
    cases = [(r.randrange(10**k), r.randrange(1, 10**15)) for k in range(1, 15) for _ in range(20)]
    c, m = (np.array(x, np.int64) for x in zip(*cases, strict=True))
    want = [1 + 10**9 * a // b for a, b in cases if a <= b]
    keep = c <= m
    assert D.share(c[keep], m[keep]).tolist() == want
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases) if a <= b], "i int, c long, m long")
    assert [x[0] for x in df.orderBy("i").selectExpr(D.share_sql("c", "m")).collect()] == want


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    text = "Abc dé-F  longlonglonglongword x1y" * 3
    assert [w for p in D.terms(text) for w in p] == D.TERM.findall(text.encode().lower())


def test_tiles_name_a_pair_the_same_way_round():
    """Rows reach a tile in any order; the partial values of a pair add up only if all its tiles call it (a, b)."""
    kinds = {"lang": pa.string(), "tb": pa.int64(), "x": pa.int64(), "y": pa.int64(), "source": pa.string(), "sb": pa.int64(),
             "total": pa.int64(), "v": pa.int64(), "term": pa.string(), "n": pa.int64()}
    found = []
    for tb, sources in ((0, ["s1", "s2", "s3"]), (1, ["s3", "s1", "s2"])):
        rows = [("en", tb, 0, 0, s, 0, 9, 2, None, 0) for s in sources] + [("en", tb, 0, 0, s, 0, 9, 2, f"t{tb}", 3) for s in sources]
        t = D._tile(pa.table({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), zip(*rows), strict=True)}))
        found.append(sorted(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)))
    assert found[0] == found[1] == [("s1", "s2"), ("s1", "s3"), ("s2", "s3")]


@pytest.mark.parametrize("hold", [1, 20, D.HOLD])
def test_slabs_hold_the_terms_of_each_text(hold, monkeypatch):
    """Arrow-coded terms of a column, also of a slice and of texts longer than a slab, equal those of each text alone."""
    monkeypatch.setattr(D, "PIECE", 200)
    texts = ["", "ab", "cd Ab1ab", "\x00", "日本 ÉÀ-é", "z" * 700, "Word word " * 90, "", "tail"]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    found = [[] for _ in texts]
    for row, code, words, _ in D.coded_terms(column, hold):
        words = words.to_pylist()
        assert len(set(words)) == len(words)
        for r, c in zip(row.tolist(), code.tolist(), strict=True):
            found[r].append(words[c])
    assert found == [D.TERM.findall(t.encode().lower()) for t in texts]
    assert list(D.coded_terms(pa.array([], pa.string()), hold)) == []
