"""TF-IDF / naive Bayes against a pure-Python reference; Spark ML classifiers; language id;
feed, sink and streaming round trips."""

import math
import os
import re
import tempfile
from collections import Counter

from gazette.operators import langid, ml

TRAIN = [(1, "stock market shares rise, market rally", "biz"), (2, "team wins the football match", "sport"),
         (3, "bank profit and market trade", "biz"), (4, "player scores in the final match", "sport")]
DOCS = [(10, "the market for football shares"), (11, "match match team"), (12, "nothing relevant here"),
        (13, "zz")]


def ref_tfidf(train_texts, docs, stop, max_features=3000):
    tok = lambda t: [w for w in re.findall(r"[^\W]{2,}", t.lower()) if w not in stop]
    per_doc = [Counter(tok(t)) for t in train_texts]
    total = Counter()
    dfc = Counter()
    for c in per_doc:
        total.update(c)
        dfc.update(c.keys())
    vocab = sorted(total, key=lambda w: (-total[w], w))[:max_features]
    n = len(train_texts)
    idf = {w: math.log((1 + n) / (1 + dfc[w])) + 1 for w in vocab}

    def vec(t):
        c = Counter(w for w in tok(t) if w in idf)
        w = {k: v * idf[k] for k, v in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        return {k: x / norm for k, x in w.items()}
    return idf, vec


def test_tfidf_and_nb_against_reference(spark):
    train = spark.createDataFrame(TRAIN, "article_id long, text string, label string")
    docs = spark.createDataFrame(DOCS, "article_id long, text string")
    stop = set(ml.english_stop_words())
    idf, vec = ref_tfidf([t for _, t, _ in TRAIN], [t for _, t in DOCS], stop)
    model = ml.fit_tfidf(train)
    got = {}
    for r in ml.transform_tfidf(model, docs).collect():
        got.setdefault(r.article_id, {})[r.term] = r.weight
    for i, t in DOCS:
        exp = vec(t)
        assert set(got.get(i, {})) == set(exp)
        assert all(abs(got[i][k] - exp[k]) < 1e-9 for k in exp)
    # multinomial NB with alpha 1 on the tf-idf vectors
    labels = sorted(set(l for _, _, l in TRAIN))
    V = len(idf)
    fc = {l: Counter() for l in labels}
    for _, t, l in TRAIN:
        fc[l].update(vec(t))
    pred = {r.article_id: (r.category, r.confidence) for r in ml.classify_nb(docs, train).collect()}
    for i, t in DOCS:
        x = vec(t)
        jll = []
        for l in labels:
            prior = math.log(sum(1 for *_, ll in TRAIN if ll == l) / len(TRAIN))
            tot = sum(fc[l].values())
            jll.append(prior + sum(v * math.log((fc[l][k] + 1) / (tot + V)) for k, v in x.items()))
        m = max(jll)
        best = labels[jll.index(m)]
        conf = 1 / sum(math.exp(j - m) for j in jll)
        assert pred[i][0] == best and abs(pred[i][1] - conf) < 1e-9


def test_spark_ml_classifiers(spark):
    train = spark.createDataFrame(TRAIN * 3, "article_id long, text string, label string")
    docs = spark.createDataFrame(DOCS, "article_id long, text string")
    for fn in (ml.classify_svm, ml.classify_rf, ml.classify_soft_vote):
        out = fn(docs, train).collect()
        assert len(out) == len(DOCS)
        assert all(r.category in ("biz", "sport") and 0 <= r.confidence <= 1 for r in out)


def test_language_identification(spark):
    train = spark.createDataFrame([("the market and the weather are with this news " * 20, "en"),
                                   ("le marché et la météo sont avec les nouvelles " * 20, "fr")],
                                  "text string, lang string")
    prof = langid.lang_profiles(train, "text", "lang")
    q = spark.createDataFrame([(1, "the weather is with the market"), (2, "la météo et le marché"), (3, "ab")],
                              "article_id long, title string")
    got = {r.article_id: r.detected for r in langid.detect_language(q, prof).collect()}
    assert got[1] == "en" and got[2] == "fr" and got[3] is None   # no trigram: undetectable


def test_feed_reader_items_and_channels(spark):
    from gazette.sources import feeds
    d = tempfile.mkdtemp(prefix="gz-feed-")
    p = os.path.join(d, "source=cnn", "chunk=0")
    os.makedirs(p)
    with open(os.path.join(p, "feed.xml"), "w") as f:
        f.write("<rss><channel><title>one</title>"
                "<item><title>  First \n</title><link>http://x/1</link></item>"
                "<item><title>Second</title><description>  Text &amp; more </description><link>http://x/2</link></item>"
                "</channel><channel><item><title>Third</title></item></channel></rss>")
    got = [(r.title, r.description, r.url) for r in feeds.read_feeds(spark, d).orderBy("pos").collect()]
    assert got == [("First", "", "http://x/1"), ("Second", "Text & more", "http://x/2"), ("Third", "", "")]


def test_feed_items_with_cdata_in_a_plain_folder(spark):
    from gazette.sources import feeds
    d = tempfile.mkdtemp(prefix="gz-feed-")
    with open(os.path.join(d, "a.xml"), "w") as f:
        f.write("<rss><channel><item><title><![CDATA[One </item> two]]></title><link>u1</link></item>"
                "<item><title>Next</title><description>a &lt;b&gt; c</description></item><item/></channel></rss>")
    got = [(r.source, r.title, r.description, r.url) for r in feeds.read_feeds(spark, d, source="npr").orderBy("pos").collect()]
    assert got[:2] == [("npr", "One </item> two", "", "u1"), ("npr", "Next", "a <b> c", "")]


def test_csv_is_read_by_pandas(spark):
    import glob

    import pandas as pd

    from gazette.sinks import files
    d = tempfile.mkdtemp(prefix="gz-csv-")
    text = 'say "hi", back\\slash\nnew line'
    df = spark.createDataFrame([(1, text, "x")], "article_id long, title string, category string")
    files.write_classified_csv(df.coalesce(1), f"{d}/csv")
    back = pd.read_csv(glob.glob(f"{d}/csv/part-*.csv")[0])
    assert back.title.tolist() == [text] and back.category.tolist() == ["x"]


def test_sinks_round_trip(spark):
    from gazette.sinks import files
    d = tempfile.mkdtemp(prefix="gz-sink-")
    df = spark.createDataFrame([(1, "T, with comma", "line\nbreak", "a", ["k1", "k2"], True)],
                               "article_id long, title string, description string, category string, "
                               "keywords array<string>, is_relevant boolean")
    files.write_classified_csv(df, f"{d}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{d}/csv").collect()[0]
    assert back.title == "T, with comma" and back.description == "line\nbreak" and back.keywords == '["k1","k2"]'
    files.write_classified_json(df, f"{d}/json", {"method": "m"})
    meta = spark.read.json(f"{d}/json/metadata").collect()[0]
    assert meta.total_articles == 1 and meta.method == "m"
    res = spark.createDataFrame([("m1", "a", 1.0), ("m2", "b", 2.0)], "method string, category string, time double")
    files.write_methods(res, res.groupBy("method").count(), f"{d}/methods")
    assert {x for x in os.listdir(f"{d}/methods/by_method") if x.startswith("method=")} == {"method=m1", "method=m2"}


def test_sink_query_classifies_once_and_compresses(spark, monkeypatch):
    """One classification and one stored copy of the texts for both files and the digest; the files are gzip."""
    from gazette import session
    from gazette.operators import cluster as G
    from gazette.plans import queries as Q
    base, calls, kept = tempfile.mkdtemp(prefix="gz-sinkq-"), [], []
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{base}/{name}")
    monkeypatch.setattr(Q, "_classified", lambda *a, real=Q._classified: calls.append(a) or real(*a))
    monkeypatch.setattr(G, "_kept", lambda df, name, real=G._kept: kept.append(df.columns) or real(df, name))
    got = Q.q_sink_roundtrip(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1 and sum("description" in c for c in kept) == 1
    for kind in ("csv", "json/articles"):
        parts = [f for f in os.listdir(f"{base}/sinks/{kind}") if f.startswith("part-")]
        assert parts and all(f.endswith(".gz") for f in parts)
    assert len(got) == 200 and all(r.csv_description == r.json_description and r.text_has_footer for r in got)


def test_streaming_ingest(spark):
    from gazette.operators.hash_store import HashStore
    from gazette.streaming.ingest import ingest_stream
    d = tempfile.mkdtemp(prefix="gz-stream-")
    schema = "pos long, title string, description string, source string"
    spark.createDataFrame([(1, "A", "x", "s"), (2, "A", "x", "s"), (3, "B", "y", "s")], schema) \
        .write.parquet(f"{d}/landing/batch1")
    q = ingest_stream(spark, f"{d}/landing/batch1", spark.createDataFrame([], schema).schema, f"{d}/store", f"{d}/ckpt")
    q.awaitTermination()
    spark.createDataFrame([(4, "B", "y", "s"), (5, "C", "z", "s")], schema).write.parquet(f"{d}/landing2")
    q = ingest_stream(spark, f"{d}/landing2", spark.createDataFrame([], schema).schema, f"{d}/store", f"{d}/ckpt2")
    q.awaitTermination()
    titles = sorted(r.title for r in HashStore(spark, f"{d}/store").articles().collect())
    assert titles == ["A", "B", "C"]


def test_cluster_and_digest_files(spark):
    from gazette.operators import digest as D
    from gazette.sinks import files
    d = tempfile.mkdtemp(prefix="gz-w3-")
    members = spark.createDataFrame([("a", 0, 1, "t1", "x", "s1"), ("a", 0, 2, "t2", "y", "s2"), ("b", -1, 3, "t3", "z", None)],
                                    "category string, cluster_id long, pos long, title string, description string, source string")
    table = members.groupBy("category", "cluster_id").count()
    files.write_clusters(table, members, d)
    back = spark.read.json(f"{d}/members")
    assert sorted((r.category, r.title, r.source) for r in back.collect()) == [("a", "t1", "s1"), ("a", "t2", "s2"),
                                                                            ("b", "t3", "")]
    items = spark.createDataFrame([(1, "T", "S", "a", 2, ["k"], ["s1"])],
                                  "rank long, title string, summary string, category string, source_count long, "
                                  "keywords array<string>, sources array<string>")
    dig = D.digest(items, "2024-02-01")
    files.write_digest(dig, D.render_text(dig), f"{d}/digest")
    assert spark.read.json(f"{d}/digest/digest").collect()[0].total_events == 1
    text = "\n".join(r.value for r in spark.read.text(f"{d}/digest/text").collect())
    assert text.startswith("*📰 News Digest for 2024-02-01*") and text.endswith("_Total: 2 articles from 1 events_")
