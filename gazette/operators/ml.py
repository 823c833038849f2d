"""TF-IDF vectors and the classifiers built on them.

* ``fit_tfidf`` / ``transform_tfidf``: scikit-style TF-IDF as DataFrame
  aggregations (tokens of two or more word characters, stop words removed,
  the ``max_features`` most frequent terms, smoothed idf
  ``ln((1+n)/(1+df)) + 1``, L2 normalisation). Output is long form
  ``(id, term, weight)``; the vocabulary is bounded by ``max_features`` so its
  join is a broadcast.
* ``classify_nb``: multinomial naive Bayes written as aggregations: per-class
  feature sums, then a per-document sum over its own terms only. Classes are
  few and bounded, so their constants are inlined as a literal.
* ``classify_svm`` / ``classify_rf`` / ``classify_soft_vote``: Spark ML on the
  same features (CountVectorizer + idf + 1 + L2 normaliser).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette import dims
from gazette.functions.text import sql_str
from gazette.operators import calibrate
from gazette.session import ensure_checkpoint_dir

DENSE_ROWS = 500
FIT_ROWS = 20_000            # training rows of one task
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def english_stop_words() -> tuple[str, ...]:
    """Spark's built-in English stop-word list (plain text in ``dims``: no jar, no JVM)."""
    return tuple(dims.ENGLISH_STOP_WORDS)


SEPARATOR_RE = r"[^\p{L}\p{N}_]+"


def tokens(df: DataFrame, id_col: str, text_col: str = "text", stop_words=None) -> DataFrame:
    """Maximal runs of word characters (letters, digits, '_') of length >= 2, lower-cased.

    Splitting on runs of non-word characters yields exactly the matches of
    ``TOKEN_RE`` plus short pieces, and is about twice as fast as extracting them.
    """
    stop = list(english_stop_words() if stop_words is None else stop_words)
    toks = (df.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), SEPARATOR_RE)).alias("term"))
            .filter(F.length("term") >= 2))
    return toks.filter(~F.col("term").isin(stop)) if stop else toks


class TfidfModel:
    def __init__(self, vocab: DataFrame, n_docs, max_features: int, stop_words, train_tf: DataFrame):
        self.vocab = vocab            # (term, idf), at most max_features rows
        self.n_docs = n_docs
        self.max_features = max_features
        self.stop_words = stop_words
        self.train_tf = train_tf      # (id, term, tf) of the training documents


def term_counts(df: DataFrame, id_col: str, text_col: str = "text", stop_words=None) -> DataFrame:
    return tokens(df, id_col, text_col, stop_words).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def fit_tfidf(train: DataFrame, id_col: str = "article_id", text_col: str = "text", max_features: int = 3000,
              stop_words=None) -> TfidfModel:
    # per-document term counts are the expensive part (whole texts); transforming
    # the training set reuses them
    ensure_checkpoint_dir(train.sparkSession)
    per_doc = term_counts(train, id_col, text_col, stop_words).checkpoint()
    per_term = per_doc.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    top = per_term.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    n = train.select(F.count("*")).scalar()
    vocab = top.select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    return TfidfModel(vocab.checkpoint(), n, max_features, stop_words, per_doc)


def weights_from_counts(model: TfidfModel, tf: DataFrame, id_col: str) -> DataFrame:
    from pyspark.sql import Window
    w = tf.join(F.broadcast(model.vocab), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def transform_tfidf(model: TfidfModel, docs: DataFrame, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """Long form ``(id, term, weight)`` with L2-normalised tf * idf per document.

    The vocabulary has at most ``max_features`` rows, so it is broadcast.
    """
    # only vocabulary terms can carry weight: drop the rest (broadcast semi join) before counting
    toks = tokens(docs, id_col, text_col, model.stop_words).join(F.broadcast(model.vocab.select("term")), "term",
                                                                 "left_semi")
    return weights_from_counts(model, toks.groupBy(id_col, "term").agg(F.count("*").alias("tf")), id_col)


def tfidf_vectors(model: TfidfModel, docs: DataFrame, id_col: str = "article_id", text_col: str = "text",
                  beside: DataFrame | None = None) -> DataFrame:
    """``(id, vec array<double>)``: TF-IDF weights as dense vectors over the vocabulary in term order.

    A vector for every document, for the operators that take one (nearest
    prototype, clustering); a document without a vocabulary term has the zero
    vector. A vector has at most ``max_features`` places; documents are dealt in
    batches of ``DENSE_ROWS``. ``beside`` is joined by ``id`` while the vectors
    are still sparse, so no join moves dense ones; its columns stand before ``vec``.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import Window

    # at most max_features rows
    terms = model.vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("i"))
    size = model.vocab.count()
    weights = transform_tfidf(model, docs, id_col, text_col).join(F.broadcast(terms), "term")
    sparse = docs.select(id_col).join(weights.groupBy(id_col).agg(
        F.collect_list(F.struct("i", "weight")).alias("_e")), id_col, "left").select(id_col, "_e")
    if beside is not None:
        sparse = sparse.join(beside, id_col)
    own = [c for c in sparse.columns if c != "_e"]
    kinds = dict(sparse.dtypes)

    def dense(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, DENSE_ROWS):
                b = whole.slice(a, DENSE_ROWS)
                out = np.zeros((b.num_rows, size))
                entries = b.column("_e")
                each = entries.flatten()
                n = pc.fill_null(pc.list_value_length(entries), 0).to_numpy()
                out[np.repeat(np.arange(b.num_rows), n), each.field("i").to_numpy()] = each.field("weight").to_numpy()
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own],
                                                  pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], [*own, "vec"])

    return sparse.mapInArrow(dense, "".join(f"`{c}` {kinds[c]}, " for c in own) + "vec array<double>")


def classify_nb(docs: DataFrame, train: DataFrame, id_col: str = "article_id", text_col: str = "text",
                label_col: str = "label", alpha: float = 1.0, max_features: int = 3000,
                method: str = "tfidf_naive_bayes") -> DataFrame:
    """TF-IDF + multinomial naive Bayes; confidence = largest class probability.

    jll(d, c) = log prior(c) + sum_t x(d,t) * log((fc(c,t) + alpha) / (total(c) + alpha * V)).
    Terms a class never saw contribute ``x * (log alpha - lnorm(c))``, so only the
    document's terms that a class did see need a join.
    """
    model = fit_tfidf(train, id_col, text_col, max_features)
    xtr = weights_from_counts(model, model.train_tf, id_col).join(train.select(id_col, label_col), id_col)
    fc = xtr.groupBy(label_col, "term").agg(F.sum("weight").alias("fc"))
    n_feat = model.vocab.select(F.count("*")).scalar()
    n_train = train.select(F.count("*")).scalar()
    cls = (train.groupBy(label_col).agg(F.count("*").alias("n_c"))
           .join(fc.groupBy(label_col).agg(F.sum("fc").alias("total")), label_col, "left")
           .select(F.col(label_col).cast("string").alias("label"), (F.log(F.col("n_c")) - F.log(n_train)).alias("prior"),
                   F.log(F.coalesce("total", F.lit(0.0)) + F.lit(alpha) * n_feat).alias("lnorm")))
    # one row per class, in label order
    classes = cls.agg(F.array_sort(F.collect_list(F.struct("label", "prior", "lnorm"))).alias("classes")).scalar()
    log_a = math.log(alpha)
    lfc = fc.select(label_col, "term", (F.log(F.col("fc") + alpha) - F.lit(log_a)).alias("lfc"))
    # x(d,t) = w(d,t) / |w(d)|: the per-document sums needed here are linear in x,
    # so they are taken on raw weights and divided by the norm afterwards (no window)
    toks = tokens(docs, id_col, text_col, model.stop_words).join(F.broadcast(model.vocab.select("term")), "term",
                                                                 "left_semi")
    w = (toks.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
         .join(F.broadcast(model.vocab), "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w")))
    seen = (w.join(lfc, "term").groupBy(id_col, label_col).agg(F.sum(F.col("w") * F.col("lfc")).alias("s"))
            .groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(label_col, "s"))).alias("smap")))
    mass = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"), F.sum("w").alias("sw"))
    per_doc = (docs.select(id_col).join(mass, id_col, "left").join(seen, id_col, "left")
               .withColumn("x", F.coalesce(F.col("sw") / F.col("nrm"), F.lit(0.0)))
               .withColumn("smap", F.transform_values("smap", lambda k, v: v / F.col("nrm"))))
    per_doc = per_doc.withColumn("_classes", classes)
    jll = F.transform("_classes", lambda c, i: F.struct(
        (c["prior"] + (F.lit(log_a) - c["lnorm"]) * F.col("x")
         + F.coalesce(F.try_element_at(F.col("smap"), c["label"]), F.lit(0.0))).alias("j"),
        (-i).alias("neg_ord"), c["label"].alias("label")))
    out = per_doc.withColumn("_j", jll).withColumn("_b", F.array_max("_j"))
    denom = F.aggregate("_j", F.lit(0.0), lambda acc, s: acc + F.exp(s["j"] - F.col("_b.j")))
    return out.select(id_col, F.col("_b.label").alias("category"), (F.lit(1.0) / denom).alias("confidence"),
                      F.lit(method).alias("method"))


# --------------------------------------------------------------------------- Spark ML classifiers
def _features(train: DataFrame, docs: DataFrame, text_col: str, label_col: str, max_features: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import (CountVectorizer, ElementwiseProduct, IDF, Normalizer, RegexTokenizer,
                                    StopWordsRemover, StringIndexer)
    from pyspark.ml.linalg import Vectors
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_RE, gaps=False, toLowercase=True)
    stop = StopWordsRemover(inputCol="_tok", outputCol="_tok2", stopWords=list(english_stop_words()))
    cv = CountVectorizer(inputCol="_tok2", outputCol="_tf", vocabSize=max_features)
    idf = IDF(inputCol="_tf", outputCol="_idf_unused")
    idx = StringIndexer(inputCol=label_col, outputCol="_y", stringOrderType="alphabetAsc")
    # texts are cut once: the counts, the idf and the vectors all read the stored tokens
    ensure_checkpoint_dir(train.sparkSession)
    cut = stop.transform(tok.transform(train.select(text_col, label_col))).select(label_col, "_tok2").checkpoint()
    fitted = Pipeline(stages=[cv, idf, idx]).fit(cut)
    idf_vec = fitted.stages[1].idf.toArray() + 1.0       # smoothed idf + 1
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf_vec), inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)
    prep = lambda d: norm.transform(scale.transform(fitted.stages[0].transform(d)))
    tr = fitted.stages[2].transform(prep(cut))
    return tr, prep(stop.transform(tok.transform(docs))), list(fitted.stages[2].labels)


def _stored(tr: DataFrame) -> DataFrame:
    """Features and labels, stored for the many passes of a fit, in partitions of about ``FIT_ROWS`` rows.

    A text scan leaves a partition for a few MB of text; as vectors these are small, and each of the hundreds of passes
    would pay for a task each.
    """
    sc = tr.sparkSession.sparkContext
    ensure_checkpoint_dir(tr.sparkSession)
    tr = tr.select("features", "_y").checkpoint()
    return tr.coalesce(max(sc.defaultParallelism, -(-tr.count() // FIT_ROWS)))


def _argmax_output(pred: DataFrame, prob_col: str, labels, id_col: str, method: str) -> DataFrame:
    lab = F.expr("array(" + ", ".join(sql_str(x) for x in labels) + ")")
    probs = F.col(prob_col)
    best = F.array_max(F.transform(probs, lambda p, i: F.struct(p.alias("p"), (-i).alias("neg_i"))))
    return pred.select(id_col, F.try_element_at(lab, (-best["neg_i"] + 1).cast("int")).alias("category"),
                       best["p"].alias("confidence"), F.lit(method).alias("method"))


def _margins(tr: DataFrame, te: DataFrame, n_classes: int) -> DataFrame:
    """``te`` with ``_m``: the margins of one-vs-rest linear SVMs fitted on ``tr``.

    With two classes the two problems mirror each other (labels swapped, weights negated), so one fit gives both margins.
    """
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import vector_to_array
    if n_classes == 2:
        model = LinearSVC(maxIter=100, labelCol="_y", featuresCol="features").fit(tr)
    else:
        model = OneVsRest(classifier=LinearSVC(maxIter=100), labelCol="_y", featuresCol="features").fit(tr)
    return model.transform(te).withColumn("_m", vector_to_array(F.col("rawPrediction"))).drop("rawPrediction", "prediction")


def svm_calibration(tr: DataFrame, n_classes: int) -> dict:
    """``class index -> (a, b)``: sigmoids fitted on the margins of rows that their model has not seen.

    Without enough rows for folds that all hold every label the margins of the fitted rows themselves are used.
    """
    dealt = calibrate.folds(tr, "_y", "features")
    if dealt is None:
        seen = _margins(tr, tr, n_classes)
    else:
        seen = None
        for f in range(calibrate.FOLDS):
            part = _margins(dealt.filter(F.col("_fold") != f).drop("_fold"), dealt.filter(F.col("_fold") == f).drop("_fold"),
                            n_classes)
            seen = part if seen is None else seen.unionByName(part)
    rows = seen.select("_y", F.posexplode("_m").alias("cls", "m"))
    return calibrate.fit_sigmoid(rows.select("cls", (F.col("_y").cast("int") == F.col("cls")).alias("y"), "m").checkpoint())


def _svm_probs(tr, te, n_classes):
    """``tr`` is read by every pass of every fit, so it comes from ``_stored``."""
    params = svm_calibration(tr, n_classes)
    return _margins(tr, te, n_classes).withColumn("_p", calibrate.probabilities(F.col("_m"), params, n_classes)).drop("_m")


def classify_svm(docs: DataFrame, train: DataFrame, id_col: str = "article_id", text_col: str = "text",
                 label_col: str = "label", max_features: int = 3000) -> DataFrame:
    """TF-IDF + one-vs-rest linear SVM; probabilities by Platt scaling on cross-fitted margins."""
    tr, te, labels = _features(train, docs, text_col, label_col, max_features)
    return _argmax_output(_svm_probs(_stored(tr), te, len(labels)), "_p", labels, id_col, "tfidf_svm")


def classify_rf(docs: DataFrame, train: DataFrame, id_col: str = "article_id", text_col: str = "text",
                label_col: str = "label", max_features: int = 3000, num_trees: int = 100) -> DataFrame:
    """TF-IDF + random forest (100 trees, seed 42)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    tr, te, labels = _features(train, docs, text_col, label_col, max_features)
    model = RandomForestClassifier(numTrees=num_trees, seed=42, labelCol="_y", featuresCol="features").fit(tr)
    pred = model.transform(te).withColumn("_p", vector_to_array("probability"))
    return _argmax_output(pred, "_p", labels, id_col, "tfidf_random_forest")


def classify_soft_vote(docs: DataFrame, train: DataFrame, id_col: str = "article_id", text_col: str = "text",
                       label_col: str = "label", max_features: int = 3000) -> DataFrame:
    """Soft vote of naive Bayes, SVM, random forest (50 trees) and logistic regression."""
    from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    tr, te, labels = _features(train, docs, text_col, label_col, max_features)
    tr = _stored(tr)
    nb = NaiveBayes(modelType="multinomial", smoothing=1.0, labelCol="_y", featuresCol="features").fit(tr)
    rf = RandomForestClassifier(numTrees=50, seed=42, labelCol="_y", featuresCol="features").fit(tr)
    lr = LogisticRegression(maxIter=1000, labelCol="_y", featuresCol="features").fit(tr)
    # one frame through all models, no join: keep each model's probabilities only
    own = ["rawPrediction", "probability", "prediction"]
    allp = te.select(id_col, "features")
    for name, model in (("p_nb", nb), ("p_rf", rf), ("p_lr", lr)):
        allp = model.transform(allp).withColumn(name, vector_to_array("probability")).drop(*own)
    allp = _svm_probs(tr, allp, len(labels)).withColumnRenamed("_p", "p_svm").drop(*own)
    avg = F.zip_with(F.zip_with("p_nb", "p_rf", lambda a, b: a + b), F.zip_with("p_lr", "p_svm", lambda a, b: a + b),
                     lambda a, b: (a + b) / 4.0)
    return _argmax_output(allp.withColumn("_p", avg), "_p", labels, id_col, "tfidf_ensemble")
