"""TF-IDF vectors and fits over many partitions: the same results with fewer passes and no moved dense vectors."""

import numpy as np

from gazette.operators import ml

TRAIN = [(i, t, l) for i, (t, l) in enumerate([("stock market shares rise", "biz"), ("team wins the football match", "sport"),
                                              ("bank profit and market trade", "biz"), ("player scores in the final match", "sport"),
                                              ("zz", "biz")] * 6)]
SCHEMA = "article_id long, text string, label string"


def test_columns_beside_sparse_vectors(spark):
    """As a join with the dense vectors gives them, also for repeated ids; the join itself does not see a dense vector."""
    train = spark.createDataFrame(TRAIN[:5] + TRAIN[:1], SCHEMA)
    model = ml.fit_tfidf(train)
    labels = train.select("article_id", "label")
    out = ml.tfidf_vectors(model, train, beside=labels)
    assert out.columns == ["article_id", "label", "vec"]
    rows = lambda df: sorted((r.article_id, r.label, [round(x, 12) for x in r.vec]) for r in df.collect())
    want = rows(ml.tfidf_vectors(model, train).join(labels, "article_id").select(*out.columns))
    assert rows(out) == want and len(want) == 8
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def _prepared(spark, rows):
    return ml._features(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA), "text", "label", 100)


def test_one_fit_gives_both_margins_of_two_classes(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import vector_to_array
    tr, te, labels = _prepared(spark, TRAIN)
    tr = ml._stored(tr)
    both = OneVsRest(classifier=LinearSVC(maxIter=100), labelCol="_y", featuresCol="features").fit(tr).transform(te)
    want = {r[0]: r[1] for r in both.select("article_id", vector_to_array("rawPrediction")).collect()}
    fits = []
    fit = LinearSVC.fit
    monkeypatch.setattr(LinearSVC, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    monkeypatch.setattr(OneVsRest, "fit", None)
    got = {r.article_id: r["_m"] for r in ml._margins(tr, te, len(labels)).select("article_id", "_m").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-6) for i in want) and len(fits) == 1


def test_three_classes_are_one_versus_rest(spark):
    tr, te, labels = _prepared(spark, [(i, t, "other" if i % 5 == 4 else lab) for i, t, lab in TRAIN])
    assert all(len(r["_m"]) == 3 for r in ml._margins(ml._stored(tr), te, len(labels)).select("_m").collect())


def test_fits_read_few_partitions(spark):
    tr, _, _ = _prepared(spark, TRAIN)
    stored = ml._stored(tr.repartition(37))
    assert stored.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and stored.count() == len(TRAIN)
