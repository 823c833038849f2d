"""The store in hash ranges: inserts, updates, statistics, streams, and what failed jobs leave behind."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gazette.operators import stats as T
from gazette.operators.hash_store import HashStore
from gazette.operators.store import article_hash
from gazette.sources import feeds
from gazette.streaming.ingest import ingest, ingest_feeds, ingest_stream

ARTICLE = "pos long, title string, description string, source string"


def md5(*parts):
    return hashlib.md5("".join(p or "" for p in parts).encode()).hexdigest()


def store_of(spark, path, rows, prefix=1):
    """A store of (id, title, category, source, is_relevant) rows."""
    store = HashStore(spark, str(path), prefix)
    df = spark.createDataFrame(rows, "id string, title string, category string, source string, is_relevant boolean")
    store.load(article_hash(df.withColumn("description", F.lit("d"))))
    return store


def many(n, first=0):
    return [(str(i), f"t{i}", f"c{i % 3}" if i % 5 else None, f"s{i % 2}", None if i % 7 == 0 else i % 2 == 0) for i in range(first, first + n)]


def counted(store):
    return sorted((tuple(r) for r in store.counts().collect()), key=repr)


def recounted(store):
    rows = store.articles().groupBy("category", "source", "is_relevant").agg(F.count("*").alias("n"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_insert_reads_the_ranges_of_the_batch(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", many(200))
    batch = spark.createDataFrame([(1, "t5", "d", "x"), (2, "new", "d", "x"), (3, "new", "d", "y"), (4, None, None, None)], ARTICLE)
    fresh = store.insert(batch, "2024-01-01 00:00:00")
    assert sorted((r.title, r.source) for r in fresh.collect()) == [("", ""), ("new", "x")]
    touched = sorted({"r" + h[0] for h in (md5("t5", "d"), md5("new", "d"), md5())})
    plan = store.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and all(f"range#" in plan for _ in touched)
    files = store.read(touched).select(F.input_file_name()).distinct().collect()
    assert {f[0].split("range=")[1][:2] for f in files} <= set(touched)
    assert store.insert(batch, "2024-01-02 00:00:00").count() == 0 and store.articles().count() == 202


def test_an_update_rewrites_the_ranges_of_its_ids(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", many(200))
    before = {r.title: r.commit for r in store.read().select("title", "commit").collect()}
    up = spark.createDataFrame([("17", False, 0.25), ("none", True, 0.5)], "id string, is_relevant boolean, relevance_confidence double")
    own = "r" + md5("t17", "d")[0]
    assert store.update_relevance(up, "2024-02-01 00:00:00") == [own]
    after = {r.title: r.commit for r in store.read().select("title", "commit").collect()}
    assert set(after) == set(before)
    assert {t for t in before if after[t] != before[t]} == {t for t in before if "r" + md5(t, "d")[0] == own}
    row = store.articles().filter("id = '17'").collect()[0]
    assert (row.is_relevant, row.relevance_confidence, str(row.relevance_updated_at)) == (False, 0.25, "2024-02-01 00:00:00")
    by_hash = up.withColumn("title_hash", F.lit(md5("t17", "d")))
    assert store.touched_by(by_hash) == [own]
    assert store.update_relevance(up.filter("id = 'none'"), "2024-02-01") == []


def test_a_failed_job_leaves_the_store_readable(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", many(50))
    old = sorted(r.title for r in store.articles().collect())
    counts = counted(store)
    boom = F.udf(lambda t: 1 / 0 if t == "bad" else t)
    batch = spark.createDataFrame([(i, f"n{i}", "d", "x") for i in range(40)] + [(99, "bad", "d", "x")], ARTICLE)
    with pytest.raises(Exception):
        store.insert(batch.withColumn("source", boom("title")), "2024-01-01")

    class Stop(Exception):
        pass

    def stop(*a):
        raise Stop
    publish, store._publish = store._publish, stop
    with pytest.raises(Stop):                                   # the data is written, the commit is not
        store.insert(batch.limit(40), "2024-01-01")
    up = spark.createDataFrame([("3", True, 0.9)], "id string, is_relevant boolean, relevance_confidence double")
    with pytest.raises(Stop):
        store.update_relevance(up, "2024-02-01")
    store._publish = publish
    assert sorted(r.title for r in store.articles().collect()) == old and counted(store) == counts
    assert store.insert(batch.limit(40), "2024-01-01").count() == 40
    assert store.articles().count() == 90


def test_statistics_equal_a_recount(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", many(120))
    store.load(article_hash(spark.createDataFrame(many(60, 500), "id string, title string, category string, source string, is_relevant boolean")
                            .withColumn("description", F.lit("e"))))
    store.insert(spark.createDataFrame([(1, "t5", "d", "x"), (2, "new", "d", None)], ARTICLE), "2024-01-01")
    assert counted(store) == recounted(store)
    up = spark.createDataFrame([(str(i), i % 3 == 0, 0.5) for i in range(0, 600, 7)], "id string, is_relevant boolean, relevance_confidence double")
    store.update_relevance(up, "2024-02-01")
    assert counted(store) == recounted(store)
    arts = store.articles()
    assert store.totals().collect() == T.store_totals(arts, arts.limit(0)).drop("total_digests").collect()
    assert [tuple(r) for r in store.count_by("category").collect()] == [tuple(r) for r in T.stats_by_category(arts).collect()]
    assert [tuple(r) for r in store.count_by("source").collect()] == [tuple(r) for r in T.stats_by_source(arts).collect()]
    n = sorted(r.title for r in arts.collect())
    store.compact()
    assert sorted(r.title for r in store.articles().collect()) == n and counted(store) == recounted(store)
    assert {len(c) for c in store.live().values()} == {1}


def test_ranges_and_commits_that_look_like_numbers(spark, tmp_path):
    store = HashStore(spark, str(tmp_path / "s"), 3)
    rows = [(h + "0" * (32 - len(h)), f"t{i}") for i, h in enumerate(["001", "1e5", "012", "999"])]
    store.load(spark.createDataFrame(rows, "title_hash string, title string"))
    assert sorted(store.live()) == ["r001", "r012", "r1e5", "r999"] and store.articles().count() == 4


def test_an_empty_store(spark, tmp_path):
    store = HashStore(spark, str(tmp_path / "none"))
    assert store.read() is None and store.articles().count() == 0 and store.counts().count() == 0
    assert store.totals().collect()[0].total_articles == 0
    assert store.insert(spark.createDataFrame([], ARTICLE), "2024-01-01").count() == 0
    assert store.update_relevance(spark.createDataFrame([("1", True, 0.1)], "id string, is_relevant boolean, relevance_confidence double"), "2024-01-01") == []
    assert store.compact() == []
    with pytest.raises(ValueError):
        HashStore(spark, "x", 0)


def land(spark, rows, path):
    spark.createDataFrame(rows, ARTICLE).coalesce(1).write.mode("append").parquet(str(path))


def test_a_title_in_two_batches_and_in_the_store_is_one_row(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", many(30))
    landing, schema = tmp_path / "in", spark.createDataFrame([], ARTICLE).schema
    run = lambda: ingest_stream(spark, str(landing), schema, store.path, str(tmp_path / "ck"), prefix=1).awaitTermination()
    land(spark, [(2, "A", "x", "late"), (1, "A", "x", "early"), (3, "t5", "d", "stored"), (4, None, None, "null")], landing)
    run()
    land(spark, [(5, "A", "x", "again"), (6, "B", "y", "s"), (7, "B", "y", "s2")], landing)
    run()
    run()                                                       # nothing landed
    got = sorted((r.title, r.source) for r in store.articles().filter("id IS NULL").collect())
    assert got == [("", "null"), ("A", "early"), ("B", "s")]
    assert store.articles().count() == 33 and counted(store) == recounted(store)


def test_a_batch_that_fails_or_runs_twice_is_stored_once(spark, tmp_path, monkeypatch):
    store = HashStore(spark, str(tmp_path / "s"), 1)
    landing, schema = tmp_path / "in", spark.createDataFrame([], ARTICLE).schema
    start = lambda: ingest(spark.readStream.schema(schema).parquet(str(landing)), store, str(tmp_path / "ck"))
    land(spark, [(1, "A", "x", "s"), (2, "B", "x", "s")], landing)
    real = HashStore._publish

    def fail(self, *a):
        raise RuntimeError("stopped before publishing")
    monkeypatch.setattr(HashStore, "_publish", fail)
    with pytest.raises(Exception):
        start().awaitTermination()
    monkeypatch.setattr(HashStore, "_publish", real)
    assert store.articles().count() == 0                        # written, never published

    def fail_after(self, *a):
        real(self, *a)
        raise RuntimeError("stopped after publishing")
    monkeypatch.setattr(HashStore, "_publish", fail_after)
    with pytest.raises(Exception):
        start().awaitTermination()
    monkeypatch.setattr(HashStore, "_publish", real)
    start().awaitTermination()
    assert sorted(r.title for r in store.articles().collect()) == ["A", "B"]


def test_feeds_as_a_stream_equal_feeds_as_a_table(spark, tmp_path):
    rows = [(i, f"Title {i % 8}", f"text <b> {i % 8} & more", f"http://x/{i}", f"s{i % 3}", i) for i in range(25)]
    arts = spark.createDataFrame(rows, "pos long, title string, description string, url string, source string, article_id long")
    feeds.write_feeds(arts, str(tmp_path / "f"), items_per_file=4)
    batch = feeds.read_feeds(spark, str(tmp_path / "f"))
    q = feeds.stream_feeds(spark, str(tmp_path / "f")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["source", "title", "description", "url", "guid"]
    ordered = lambda df: [tuple(r) for r in df.orderBy("pos").select(*cols).collect()]
    assert ordered(spark.read.parquet(str(tmp_path / "out"))) == ordered(batch) and batch.count() == 25

    ingest_feeds(spark, str(tmp_path / "f"), str(tmp_path / "s"), str(tmp_path / "ck2"), prefix=1).awaitTermination()
    got = sorted((r.title, r.url) for r in HashStore(spark, str(tmp_path / "s"), 1).articles().collect())
    first = {}
    for r in batch.orderBy("pos").collect():
        first.setdefault((r.title, r.description), r.url)
    assert got == sorted((t, u) for (t, _), u in first.items())


def test_types_survive_the_state(spark, tmp_path):
    ddl = "pos long, title string, description string, source string, published timestamp, score double, tags array<string>"
    rows = [(1, "A", "x\ny \"q\"", "s", "2024-01-02 03:04:05.678901", 0.1 + 0.2, ["a", None]), (2, "B", None, None, None, None, None)]
    df = spark.createDataFrame([(*r[:4], None, *r[5:]) for r in rows], ddl).drop("published")
    df = df.join(spark.createDataFrame([(r[0], r[4]) for r in rows], "pos long, p string"), "pos").withColumn("published", F.col("p").cast("timestamp")).drop("p")
    df.write.parquet(str(tmp_path / "in"))
    store = HashStore(spark, str(tmp_path / "s"), 1)
    ingest_stream(spark, str(tmp_path / "in"), df.schema, store.path, str(tmp_path / "ck"), prefix=1).awaitTermination()
    got = {r.title: r for r in store.articles().collect()}
    assert got["A"].description == rows[0][2] and got["B"].description == "" and got["B"].published is None
    assert got["A"].published.isoformat(" ") == rows[0][4]
    assert os.path.isdir(tmp_path / "ck" / "seeds")


def test_a_large_range_is_written_by_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = [(f"{i:05d}" * 40, f"text {i}", "s") for i in range(4000)]
    df = article_hash(spark.createDataFrame(rows, "title string, description string, source string").repartition(8))
    store = HashStore(spark, str(tmp_path / "s"), 1)
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        store.load(df)
    finally:
        spark.conf.set(key, before)
    for r in range(16):
        assert len(list((tmp_path / "s" / "data" / f"range=r{r:x}").glob("*/*.parquet"))) > 1
    assert sorted(tuple(r) for r in store.articles().select("title", "description", "source").collect()) == rows


def test_feed_files_are_filled_and_keep_the_order(spark, tmp_path):
    rows = [(i, f"T{i}", "d", f"u{i}", f"s{i % 5}", i) for i in range(200)] + [(None, "N", "d", "u", "s1", 200)]
    arts = spark.createDataFrame(rows, "pos long, title string, description string, url string, source string, article_id long")
    feeds.write_feeds(arts, str(tmp_path / "f"), items_per_file=4)
    files = list((tmp_path / "f").glob("*/*/*.txt"))
    assert len(files) == 4 * 10 + 11                       # as many as the items need, not one per source and chunk
    out = feeds.read_feeds(spark, str(tmp_path / "f"))
    got = [(r.source, int(r.guid)) for r in out.filter("pos.chunk IS NOT NULL").orderBy("pos").collect()]
    assert got == [(r[4], r[5]) for r in sorted(rows[:200], key=lambda r: (r[0] // 4, r[4], r[0]))]
    assert sorted(int(r.guid) for r in out.filter("pos.chunk IS NULL").collect()) == [200]
