"""Collection (P1-P9) and relevance gate (R1-R5) on hand-built rows."""

from support import rows

from gazette.operators import collect as P
from gazette.operators import relevance as R

SCHEMA = "source string, pos long, title string, description string, language string"


def test_trim_and_missing_description(spark):
    df = spark.createDataFrame([("a", 1, " \t Title\n", None, "en")], SCHEMA)
    out = P.trim_text(df).collect()[0]
    assert out.title == "Title" and out.description == ""


def test_cap_per_source_before_filters(spark):
    data = [("a", i, f"t{i}", "", "en") for i in range(35)] + [("b", i, f"u{i}", "", "en") for i in range(2)]
    out = P.cap_per_source(spark.createDataFrame(data, SCHEMA), 30)
    got = rows(out, "source", "pos")
    assert len([r for r in got if r[0] == "a"]) == 30 and ("a", 30) not in got and ("b", 1) in got


def test_title_rejected_by_length_is_accepted_later(spark):
    long = "x" * 900
    data = [("a", 1, "Same", long, "en"), ("a", 2, "Same", "short", "en"), ("b", 1, "Same", "again", "en"),
            ("a", 3, "", "no title", "en"), ("a", 4, "French", "", "fr")]
    out = P.collect_pipeline(spark.createDataFrame(data, SCHEMA), max_total=10)
    assert rows(out, "source", "pos", "title") == [("a", 2, "Same")]


def test_length_limit_is_inclusive(spark):
    data = [("a", 1, "t" * 400, "d" * 400, "en"), ("a", 2, "u" * 400, "d" * 401, "en")]
    out = P.filter_length(spark.createDataFrame(data, SCHEMA), 800)
    assert rows(out, "pos") == [(1,)]


def test_cap_total_in_source_order_and_report(spark):
    data = [("b", 1, "b1", "", "en"), ("a", 2, "a2", "", "en"), ("a", 1, "a1", "", "en")]
    out = P.collect_pipeline(spark.createDataFrame(data, SCHEMA), max_total=2)
    assert rows(out, "title") == [("a1",), ("a2",)]
    rep = P.collect_report(out).collect()[0]
    assert (rep.articles, rep.sources) == (2, 1)


def reference_relevance(text, irr, rel):
    low = text.lower()
    i = sum(1 for k in irr if k in low)
    r = sum(1 for k in rel if k in low)
    n = len(text.split())
    if i > 2:
        return False, 0.1
    if r == 0 and n < 10:
        return False, 0.3
    if n < 5:
        return False, 0.2
    if n > 500:
        return False, 0.2
    if r > 0:
        return True, min(0.9, 0.5 + r * 0.1)
    return True, 0.7


def test_relevance_rule_boundaries(spark):
    irr, rel = ["spam", "scam", "fraud"], ["market", "stock", "bank", "trade", "profit"]
    words = lambda n, extra="": " ".join(["w"] * n) + extra
    texts = [
        "spam scam fraud " + words(20),          # 3 irrelevant hits
        "spam scam " + words(20),                # 2 hits
        words(9), words(10),                     # no relevant, 9 / 10 words
        "market " + words(3), "market " + words(4),   # 4 / 5 words with a relevant hit
        "market " + words(499), "market " + words(500),  # 500 / 501 words
        "market stock " + words(10), "market stock bank " + words(10),
        "market stock bank trade " + words(10), "market stock bank trade profit " + words(10),
        " MARKET\tnews\n\n" + words(3),       # case-insensitive, any white space
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: (r.is_relevant, round(r.relevance_confidence, 6))
           for r in R.check_relevance(df, irr, rel, "text").collect()}
    for i, t in enumerate(texts):
        exp = reference_relevance(t, irr, rel)
        assert got[i] == (exp[0], round(exp[1], 6)), (i, t[:40])


def test_split_and_report(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, is_relevant boolean")
    rel, irr = R.split_relevance(df)
    assert rows(rel, "id") == [(1,), (3,)] and rows(irr, "id") == [(2,)]
    rep = R.relevance_report(df).collect()[0]
    assert (rep.relevant, rep.total, rep.percent) == (2, 3, 66.7)


def test_python_whitespace_semantics(spark):
    from gazette.functions.text import trim_ws, word_count
    texts = ["\x1c a b\x1f", " x　y ", "\t\n", "a\x85b", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r.id: (r.s, r.n) for r in df.select("id", trim_ws("t").alias("s"), word_count("t").alias("n")).collect()}
    assert got == {i: (t.strip(), len(t.split())) for i, t in enumerate(texts)}


def test_spread_is_the_callers_choice(spark):
    from gazette.session import spread
    df = spark.range(100).coalesce(1)
    assert spread(df) is df
    spark.conf.set("gazette.input.partitions", "4")
    try:
        out = spread(df)
        assert out.rdd.getNumPartitions() == 4 and sorted(r.id for r in out.collect()) == list(range(100))
    finally:
        spark.conf.unset("gazette.input.partitions")


def test_feed_order_beats_source_name(spark):
    data = [("bbc_world", 1, "Same", "", "en"), ("cnn", 1, "Same", "", "en"), ("zzz", 1, "Other", "", "en"), ("npr", 2, "N", "", "en")]
    df = P.with_source_order(spark.createDataFrame(data, SCHEMA))
    out = P.collect_pipeline(df, max_total=2)
    assert rows(out, "source", "title") == [("cnn", "Same"), ("npr", "N")]


def test_split_reads_the_texts_once(spark):
    """Both sides come from stored flags: the result no longer reads the documents."""
    from gazette.plans.queries import q_relevance, q_relevance_split
    sf = "/root/testdata/sf0.001"
    out = q_relevance_split(spark, sf)
    assert out.inputFiles() == []
    want = {r.article_id: "relevant" if r.is_relevant else "irrelevant" for r in q_relevance(spark, sf).collect()}
    assert {r.article_id: r.side for r in out.collect()} == want
