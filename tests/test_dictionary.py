"""Dictionaries of any size: the automaton and both operators against plain substring tests."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gazette.functions import automaton as A
from gazette.functions import word_index as W
from gazette.operators import classify as C
from gazette.operators import dictionary as D
from gazette.operators import relevance as R

SF = "/root/testdata/sf0.001"
small = st.text("abé ", max_size=5)


@settings(max_examples=150, deadline=None)
@given(st.sets(small.filter(bool), min_size=1, max_size=25), st.lists(st.text("abcé ", max_size=50), max_size=8), st.sampled_from([1, 7, 1024]))
def test_automaton_finds_every_contained_entry(entries, texts, lane):
    entries = sorted(e.encode() for e in entries)
    raw = [t.encode() for t in texts]
    A.LANE, old = lane, A.LANE
    try:
        i, j = A.Automaton(entries).find(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64))
    finally:
        A.LANE = old
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x, t in enumerate(raw) for y, e in enumerate(entries) if e in t}


def plain(text, groups):
    return {g: n for g, own in enumerate(groups) if (n := 0 if text is None else sum(e in text for e in own))}


def found(df):
    return {r.id: {h.grp: h.n for h in r.hits} for r in df.collect()}


@pytest.mark.parametrize("cells", [D.CELLS, 2000, 300])
def test_groups_repeats_empty_entries_and_nulls(spark, cells):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 4)))
    groups = [[word() for _ in range(40)], ["", "a", "a", "Zz"], [], [word() for _ in range(90)], [""]]
    texts = [None, "", "a", "xyz", "日本 é" * 50] + ["".join(r.choices("abcdeé -", k=r.randint(0, 400))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, grp string")
    assert len(D.compile_groups(groups, cells)) > 1 or cells == D.CELLS
    out = D.dictionary_hits(df, groups, "text", cells=cells)
    assert out.columns == ["id", "text", "grp", "hits"]
    assert found(out) == {i: plain(t, groups) for i, t, _ in rows}
    assert D.dictionary_hits(df.limit(0), groups, "text", cells=cells).count() == 0
    assert found(D.dictionary_hits(df, [[], []], "text")) == {i: {} for i, _, _ in rows}


def test_fifty_thousand_entries_equal_the_literal_form(spark):
    """Counts and classes of 50,000 entries against substring tests of every entry."""
    r = random.Random(9)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    seen = sorted({t[i:i + r.randint(3, 9)].lower() for _, t in docs for i in range(0, len(t), 40)})
    entries = seen[:20_000] + ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(50_000 - len(seen[:20_000]))]
    r.shuffle(entries)
    groups = [(f"g{k}", entries[k::5]) for k in range(5)]
    some = [d for d in docs if len(d.text) < 3000][:60]
    df = spark.createDataFrame(some)
    want = {i: plain(t.lower(), [e for _, e in groups]) for i, t in some}
    got = {r.doc_id: (r.irrelevant_hits, r.relevant_hits) for r in
           R.keyword_hits(df, groups[0][1], groups[1][1], "text").collect()}
    assert got == {i: (want[i].get(0, 0), want[i].get(1, 0)) for i in want}
    best = {i: max(w.items(), key=lambda x: (x[1], -x[0])) if w else None for i, w in want.items()}
    out = {r.doc_id: (r.category, r.confidence) for r in C.classify_keyword(df, groups, "text").collect()}
    assert out == {i: (f"g{b[0]}", min(1.0, b[1] / 10_000)) if b else ("world", 0.0) for i, b in best.items()}
    assert sum(len(w) for w in want.values()) > 100


def test_short_and_long_path_agree(spark, monkeypatch):
    from gazette import dims
    df = spark.createDataFrame([(1, "Shares and a match"), (2, None), (3, ""), (4, "the market rally, Election")], "article_id long, text string")
    short = C.classify_keyword(df, dims.CATEGORY_KEYWORDS, "text").collect()
    gate = R.check_relevance(df, text_col="text", keep_scores=True).collect()
    monkeypatch.setattr(C, "SHORT", 0)
    monkeypatch.setattr(R, "SHORT", 0)
    assert C.classify_keyword(df, dims.CATEGORY_KEYWORDS, "text").select(short[0].__fields__).collect() == short
    assert R.check_relevance(df, text_col="text", keep_scores=True).select(gate[0].__fields__).collect() == gate


def test_dictionary_tables(spark):
    rows = [("a", "alpha beta"), ("a", "alpha gamma Alpha"), ("b", "beta gamma delta"), ("b", "delta alphas"), (None, "delta"), ("b", None)]
    df = spark.createDataFrame(rows, "label string, text string")
    lex = D.exclusive_lexicon(df, "label", min_rows=2, min_chars=4)
    assert sorted(map(tuple, lex.collect())) == [("a", "alpha", 2), ("b", "delta", 2)]
    names, groups = D.dictionary_groups(lex)
    assert names == ["a", "b"] and groups == [["alpha"], ["delta"]]
    with pytest.raises(ValueError, match="more than 1 entries"):
        D.dictionary_groups(lex, max_entries=1)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé-", min_size=1, max_size=6), min_size=1, max_size=25), st.lists(st.text("abcé -\n\x00", max_size=50), max_size=8))
def test_word_index_finds_every_contained_entry(entries, texts):
    entries = sorted(e.encode() for e in entries)
    raw = [t.encode() for t in texts]
    i, j = W.WordIndex(entries).find(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x, t in enumerate(raw) for y, e in enumerate(entries) if e in t]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(W._Windows, "hashes", lambda self, start, length: np.zeros(len(start), np.uint64))
    entries = [b"ab", b"ba", b"bb", b"abba"]
    i, j = W.WordIndex(entries).find(np.frombuffer(b"xabbay ba", np.uint8), np.array([0, 6, 9]))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1)]


def test_a_large_dictionary_of_words_is_one_pass(spark):
    """However small an automaton has to be, words need one matcher; entries with white space go into automata."""
    r = random.Random(5)
    words = sorted({"".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(300)})
    assert len(D.compile_groups([words], 300)) > 10 and len(D.compile_groups([words], 300, words=True)) == 1
    groups = [words[::2], [*words[1::2], "a b", "é\nd", ""]]
    texts = [None, "", "a b", *["".join(r.choices("abcdeé -\n", k=r.randint(0, 400))) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert found(D.dictionary_hits(df, [words], "text", cells=300)) == {i: plain(t, [words]) for i, t in enumerate(texts)}
    assert found(D.dictionary_hits(df, groups, "text", cells=300)) == {i: plain(t, groups) for i, t in enumerate(texts)}


def test_a_dictionary_table_of_any_size_is_matched_in_parts(spark, monkeypatch):
    """Beyond what is collected the groups stay tables: the same hits, from several matchers, and nothing is refused."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(400)]
    entries = [("x", w) for w in words[:250]] + [("y", w) for w in words[250:]] + [("y", "a b"), ("y", "a b"), ("x", ""), ("z", "é\nd"), (None, "a"), ("x", None)]
    table = spark.createDataFrame(entries, "grp string, entry string")
    names, lists = D.dictionary_groups(table)
    assert names == ["x", "y", "z"] and all(isinstance(g, list) for g in lists)
    monkeypatch.setattr(D, "COLLECT", 10)
    monkeypatch.setattr(D, "PART", 60)
    names, groups = D.dictionary_groups(table)
    assert names == ["x", "y", "z"] and list(map(len, groups)) == list(map(len, lists)) and list(map(list, groups)) == lists
    assert all(isinstance(g, D.StoredEntries) for g in groups) and len(list(D._matchers(spark, groups, D.CELLS))) >= 7
    texts = [None, "", "a b", *["".join(r.choices("abcdeé -\n", k=r.randint(0, 400))) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {i: plain(t, lists) for i, t in enumerate(texts)}
    assert found(D.dictionary_hits(df, groups, "text")) == want
    mixed = [["b", "b", "", "zz"], groups[1], [], groups[1]]
    assert found(D.dictionary_hits(df, mixed, "text")) == {i: plain(t, [mixed[0], lists[1], [], lists[1]]) for i, t in enumerate(texts)}
    monkeypatch.setattr(C, "SHORT", 0)
    named = lambda of: [r[1:] for r in C.classify_keyword(df, list(zip(names, of, strict=True)), "text").orderBy("id").collect()]
    assert named(groups) == named(lists)


def test_a_large_word_index_takes_little_memory():
    """200,000 words: the index, and what is held while it is built."""
    import pickle
    import tracemalloc

    import pyarrow as pa
    words = pa.array(sorted({f"{i * 7919 % 1_000_003:06d}é{i % 13}" for i in range(200_000)}))
    table = pa.table({"e": words, "grp": pa.array(np.arange(len(words)) % 3, pa.int32()), "n": pa.array(np.ones(len(words)), pa.int64())})
    tracemalloc.start()
    (matcher,) = D._compile_table(table, D.CELLS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pickle.dumps(matcher)) < 45 * len(words) and peak < 250 * len(words)
    text, group, n = matcher.find(pa.array([words[5].as_py() + " x" + words[7].as_py() + "y", None]))
    assert sorted(zip(text.tolist(), group.tolist(), n.tolist(), strict=True)) == [(0, 1, 1), (0, 2, 1)]
