"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or data Spark derives from them) in
full. Output columns are flat scalars: arrays are joined into strings and
doubles rounded to 6 places so results compare exactly with the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette import dims
from gazette.functions.text import compose_text as _compose
from gazette.operators import classify as C
from gazette.operators import cluster as G
from gazette.operators import collect as P
from gazette.operators import dictionary as DI
from gazette.operators import digest as D
from gazette.operators import relevance as R
from gazette.operators import stats as T
from gazette.operators import store as K
from gazette.plans import pipelines as PL
from gazette.session import spread
from gazette.sources import fixtures as fx

EPS = 0.7
TREE_EPS = 0.7
TREE_BLOCK = 8               # rows of a leaf in the queries on small blocks
STORE_PREFIX = 1             # 16 ranges for the stores that the queries build
PROTOTYPE_BLOCK = 1 << 16    # bytes of a block in the query, so that it has several
LEXICON_ROWS, LEXICON_CHARS = 5, 6
MIN_SAMPLES = 2
MAX_EVENTS = 7
AS_OF = "2024-02-01"
RUN_TS = "2024-02-01 00:00:00"
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
ANSWER_LABELS = [k for _, kws in dims.FIXTURE_CATEGORY_KEYWORDS for k in kws]
ANSWER_MODEL = "qwen/qwen-2.5-72b-instruct"
DESCRIPTION_LABELS = [d for _, d in dims.BASIC_CATEGORIES] + ["Other news"]
SUB_CATEGORIES = [c for c, _ in dims.ENHANCED_CATEGORIES] + ["misc"]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ts_str(c):
    return F.date_format(F.col(c), TS_FMT)


# --------------------------------------------------------------------------- shared inputs
def _plain(spark, sf):
    return fx.articles(spark, sf, with_published=False, with_url=False, with_labels=False)


def _texts(spark, sf):
    return _plain(spark, sf).select("article_id", _compose().alias("text"))


def _protos(spark, sf):
    """Label-mean prototypes, from the vectors alone (no text is read); stored, so that every reader gets the same sums."""
    return C.build_prototypes(fx.labelled_embeddings(spark, sf), "category", "vec", ord_col="label").checkpoint()


def _classified(spark, sf):
    """Article vectors classified to the nearest label-mean prototype."""
    av = fx.labelled_vectors(spark, sf)
    return C.classify_nearest(av, _protos(spark, sf))


def _members(spark, sf, min_samples=MIN_SAMPLES):
    return G.cluster_members(_classified(spark, sf), EPS, min_samples)


def _cluster_table(spark, sf, members=None):
    members = _members(spark, sf) if members is None else members
    return members, G.clusters(members)


def _top(spark, sf, n=MAX_EVENTS, members=None):
    members, table = _cluster_table(spark, sf, members)
    return members, G.top_clusters(table, n=n)


def _items(spark, sf, language="english", members=None):
    members, top = _top(spark, sf, members=members)
    return D.digest_items(top, members, max_items=MAX_EVENTS, language=language)


def _flat_items(items):
    return items.select("rank", "title", "summary", "category", F.col("source_count").cast("long"),
                        F.array_join("keywords", ",").alias("keywords"),
                        F.array_join("sources", ",").alias("sources"))


# --------------------------------------------------------------------------- collection
def q_collect_cap_per_source(spark, sf):
    return P.cap_per_source(P.trim_text(_plain(spark, sf))).select("article_id", "source", "title", "description")


def _collected_until(spark, sf, stage):
    out = P.require_title(P.cap_per_source(P.trim_text(_plain(spark, sf))))
    out = P.filter_language(out, "en")
    if stage == "language":
        return out
    out = P.filter_length(out, 800)
    if stage == "length":
        return out
    return P.dedup_title(out)


def q_collect_language(spark, sf):
    return _collected_until(spark, sf, "language").select("article_id", "source", "title")


def q_collect_length(spark, sf):
    return _collected_until(spark, sf, "length").select("article_id", "source", "title")


def q_collect_dedup_title(spark, sf):
    return _collected_until(spark, sf, "dedup").select("article_id", "source", "title")


def q_collect_pipeline(spark, sf):
    return P.collect_pipeline(_plain(spark, sf), max_total=100).select("article_id", "source", "title",
                                                                         "description")


def q_collect_report(spark, sf):
    return P.collect_report(P.collect_pipeline(_plain(spark, sf), max_total=100))


def q_compose_text(spark, sf):
    df = _plain(spark, sf)
    return df.select("article_id", _compose().alias("text"),
                     _compose(prefix=dims.E5_QUERY_PREFIX).alias("text_e5"))


# --------------------------------------------------------------------------- relevance
def q_keyword_hits(spark, sf):
    return R.keyword_hits(_texts(spark, sf), dims.FIXTURE_IRRELEVANT, dims.FIXTURE_RELEVANT, "text") \
        .select("article_id", "irrelevant_hits", "relevant_hits")


def _relevance(spark, sf):
    return R.check_relevance(_texts(spark, sf), dims.FIXTURE_IRRELEVANT, dims.FIXTURE_RELEVANT, "text",
                             keep_scores=True)


def q_relevance(spark, sf):
    return _relevance(spark, sf).select("article_id", "is_relevant", r6("relevance_confidence")
                                        .alias("relevance_confidence"), "word_count")


def q_relevance_split(spark, sf):
    # stored, so that both sides read flags and not the texts
    rel, irr = R.split_relevance(_relevance(spark, sf).select("article_id", "is_relevant").checkpoint())
    return (rel.select("article_id", F.lit("relevant").alias("side"))
            .unionByName(irr.select("article_id", F.lit("irrelevant").alias("side"))))


def q_relevance_report(spark, sf):
    return R.relevance_report(_relevance(spark, sf))


def _lexicons(spark, sf, label):
    """Groups of words that only documents of one value of ``label`` hold: a dictionary that grows with the data."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", "lang")
    rows = docs.join(fx.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id") if label == "quality" else docs
    return DI.dictionary_groups(DI.exclusive_lexicon(rows, label, min_rows=LEXICON_ROWS, min_chars=LEXICON_CHARS))


def q_keyword_hits_lexicon(spark, sf):
    """R1 with dictionaries of any size: words of rejected and of accepted documents, in every article."""
    names, groups = _lexicons(spark, sf, "quality")
    of = dict(zip(names, groups, strict=True))
    hits = DI.dictionary_hits(_texts(spark, sf), [of.get("0", []), of.get("1", [])], F.lower("text"))
    return hits.select("article_id", DI.hits_of(0).alias("irrelevant_hits"), DI.hits_of(1).alias("relevant_hits"))


# --------------------------------------------------------------------------- classification
def q_classify_lexicon(spark, sf):
    """C1 with a dictionary per language: the words that only its documents hold."""
    names, groups = _lexicons(spark, sf, "lang")
    out = C.classify_keyword(_texts(spark, sf), list(zip(names, groups, strict=True)), "text")
    return out.select("article_id", "category", r6("confidence").alias("confidence"))


def q_classify_keyword(spark, sf):
    out = C.classify_keyword(_texts(spark, sf), dims.FIXTURE_CATEGORY_KEYWORDS, "text")
    return out.select("article_id", "category", r6("confidence").alias("confidence"), "method")


def q_prototypes(spark, sf):
    protos = _protos(spark, sf)
    return protos.select("ord", "category", F.posexplode("vec").alias("dim", "x")) \
        .select("ord", "category", F.col("dim").cast("long").alias("dim"), r6("x").alias("x"))


def q_classify_nearest(spark, sf):
    return _classified(spark, sf).select("article_id", "category", r6("confidence").alias("confidence"))


def q_classify_nearest_table(spark, sf):
    """C2 and C3 with a table of prototypes: the mean vector of every label and source, in blocks."""
    from pyspark.sql import Window

    from gazette.operators.nearest import classify_nearest_table
    av = fx.labelled_vectors(spark, sf)
    named = av.filter(F.col("vec").isNotNull()).withColumn("proto", F.concat_ws("/", "category", "source"))
    means = C.build_prototypes(named.withColumn("_one", F.lit(0)), "proto", "vec", ord_col="_one")
    ranked = means.select(F.row_number().over(Window.orderBy("category")).alias("ord"), "category", "vec")
    out = classify_nearest_table(av.drop("category"), ranked, block_bytes=PROTOTYPE_BLOCK)
    return out.select("article_id", "category", r6("confidence").alias("confidence"))


def _scores(spark, sf, labels=None):
    return C.score_table(fx.labelled_vectors(spark, sf), _protos(spark, sf), labels=labels)


def q_label_top1(spark, sf):
    return C.top_label(_scores(spark, sf)).select("article_id", "category", r6("confidence").alias("confidence"))


def q_label_from_description(spark, sf):
    top = C.top_label(_scores(spark, sf, DESCRIPTION_LABELS), method="zero_shot_deberta")
    return C.label_from_description(top).select("article_id", "category")


def q_vote_weighted(spark, sf):
    out = C.vote_weighted(fx.method_results(spark, sf))
    return out.select("article_id", "category", r6("confidence").alias("confidence"), "method")


def q_label_from_answer(spark, sf):
    out = C.label_from_answer(fx.answers(spark, sf), cats=ANSWER_LABELS, model=ANSWER_MODEL)
    return out.select("conv_id", "turn", "category", "confidence", "method")


def _gated(spark, sf):
    return C.classify_gated(fx.labelled_vectors(spark, sf), _protos(spark, sf), dims.FIXTURE_IRRELEVANT,
                            dims.FIXTURE_RELEVANT)


def q_classify_gated(spark, sf):
    return _gated(spark, sf).select("article_id", "is_relevant", r6("relevance_confidence")
                                    .alias("relevance_confidence"), "category", r6("confidence").alias("confidence"))


def q_category_rollup(spark, sf):
    subs = F.expr("array(" + ", ".join(f"'{s}'" for s in SUB_CATEGORIES) + ")")
    mr = fx.method_results(spark, sf).withColumn(
        "category", F.try_element_at(subs, (F.col("pos") % len(SUB_CATEGORIES) + 1).cast("int")))
    return C.category_rollup(mr)


def q_training_rows(spark, sf):
    tr = fx.training(spark, sf).withColumn("ord", F.lit(0))
    return C.training_rows(tr, 3, "text", "label").select(
        F.col("text"), "label", F.col("copy").cast("long").alias("copy"))


# --------------------------------------------------------------------------- TF-IDF family
def q_tfidf(spark, sf):
    from gazette.operators import ml
    model = ml.fit_tfidf(fx.training(spark, sf))
    weights = ml.transform_tfidf(model, _texts(spark, sf), id_col="article_id")
    return weights.select("article_id", "term", r6("weight").alias("weight"))


def q_classify_nb(spark, sf):
    from gazette.operators import ml
    out = ml.classify_nb(_texts(spark, sf), train=fx.training(spark, sf), id_col="article_id")
    return out.select("article_id", "category", r6("confidence").alias("confidence"))


def q_classify_tfidf_nearest(spark, sf):
    """Articles without given vectors: TF-IDF vectors (V1) to the nearest mean vector of the labelled articles."""
    from gazette.operators import ml
    train = fx.training(spark, sf)
    model = ml.fit_tfidf(train)
    labelled = ml.tfidf_vectors(model, train, beside=train.select("article_id", "label"))
    protos = C.build_prototypes(labelled, "label", "vec")
    out = C.classify_nearest(ml.tfidf_vectors(model, _texts(spark, sf)), protos)
    return out.select("article_id", "category", r6("confidence").alias("confidence"))


def _ml_query(name):
    def q(spark, sf):
        from gazette.operators import ml
        fn = getattr(ml, name)
        return fn(_texts(spark, sf), train=fx.training(spark, sf), id_col="article_id") \
            .select("article_id", "category", r6("confidence").alias("confidence"), "method")
    return q


# --------------------------------------------------------------------------- language identification
def q_lang_detect(spark, sf):
    from gazette.operators import langid
    docs = spread(fx.table(spark, sf, "documents").select("doc_id", "text", "lang"))
    profiles = langid.lang_profiles(docs, "text", "lang")
    out = langid.detect_language(_plain(spark, sf), profiles, "title", id_col="article_id")
    return out.select("article_id", "detected", r6("score").alias("score"))


def q_collect_detected(spark, sf):
    """Collection keeping titles identified as English (P4 on P5); undetectable titles are dropped."""
    from gazette.operators import langid
    docs = spread(fx.table(spark, sf, "documents").select("doc_id", "text", "lang"))
    profiles = langid.lang_profiles(docs, "text", "lang")
    arts = langid.detect_language(_plain(spark, sf), profiles, "title", id_col="article_id")
    arts = arts.withColumn("language", F.col("detected")).drop("detected", "score")
    return P.collect_pipeline(arts, max_total=100).select("article_id", "source", "title")


# --------------------------------------------------------------------------- clustering
def q_neighbor_pairs(spark, sf):
    pairs = G.neighbor_pairs(_classified(spark, sf), EPS)
    return pairs.select("category", "a", "b", r6("dist").alias("dist"))


def q_dbscan(spark, sf):
    return _members(spark, sf).select("category", "pos", "cluster_id", "is_noise")


def q_dbscan_border(spark, sf):
    return _members(spark, sf, 4).select("category", "pos", "cluster_id", "is_noise")


def q_neighbor_pairs_tree(spark, sf):
    """G1 over many small leaves of the metric tree: the same pairs as in one block."""
    pairs = G.neighbor_pairs(_classified(spark, sf), TREE_EPS, block_size=TREE_BLOCK)
    return pairs.select("category", "a", "b", r6("dist").alias("dist"))


def q_dbscan_tree(spark, sf):
    """G2 over many small leaves of the metric tree."""
    members = G.cluster_members(_classified(spark, sf), TREE_EPS, 4, block_size=TREE_BLOCK)
    return members.select("category", "pos", "cluster_id", "is_noise")


def q_clusters(spark, sf):
    _, table = _cluster_table(spark, sf)
    return table.select("category", "cluster_id", F.col("size").cast("long"), "is_noise", "main_title",
                        "main_source", F.array_join("keywords", ",").alias("keywords"))


def q_cluster_keywords(spark, sf):
    kw = G.cluster_keywords(_members(spark, sf))
    return kw.select("category", "cluster_id", F.array_join("keywords", ",").alias("keywords"))


def q_significant_clusters(spark, sf):
    _, table = _cluster_table(spark, sf)
    return G.significant_clusters(table)


def q_top_clusters(spark, sf):
    _, top = _top(spark, sf, n=10)
    return top.select("rank", "category", "cluster_id", F.col("size").cast("long"), "main_title")


def q_clusters_trimmed(spark, sf):
    from gazette.sinks import files
    return files.clusters_trimmed(_members(spark, sf))


# --------------------------------------------------------------------------- digest
def q_cluster_text(spark, sf):
    members = _members(spark, sf)
    real = members.filter(~F.col("is_noise"))
    return D.cluster_text(real)


def q_summary_prompt(spark, sf):
    members, top = _top(spark, sf)
    texts = D.cluster_text(members.join(top.select(*D.KEY), D.KEY, "left_semi"))
    en = D.summary_prompt(texts, "english").select(*D.KEY, F.lit("english").alias("language"), "system_prompt",
                                                    "user_prompt")
    ru = D.summary_prompt(texts, "russian").select(*D.KEY, F.lit("russian").alias("language"), "system_prompt",
                                                    "user_prompt")
    return en.unionByName(ru)


def q_fallback_summary(spark, sf):
    members, table = _cluster_table(spark, sf)
    src = D.cluster_sources(members)
    base = table.join(src, D.KEY)
    en = D.fallback_summary(base, "english").select(*D.KEY, F.col("fallback").alias("summary_en"))
    ru = D.fallback_summary(base, "russian").select(*D.KEY, F.col("fallback").alias("summary_ru"))
    return en.join(ru, D.KEY)


def q_digest_items(spark, sf):
    return _flat_items(_items(spark, sf))


def q_digest(spark, sf):
    dig = D.digest(_items(spark, sf), AS_OF)
    return dig.drop("items")


def q_digest_text(spark, sf):
    return D.render_text(D.digest(_items(spark, sf), AS_OF))


def _run_gated(spark, sf):
    vectors = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("article_id"),
                                                       F.col("embedding").cast("array<double>").alias("vec"))
    return PL.run_digest_gated(fx.store_articles(spark, sf), vectors, _protos(spark, sf), AS_OF, None, dims.FIXTURE_IRRELEVANT,
                               dims.FIXTURE_RELEVANT, EPS, MIN_SAMPLES, MAX_EVENTS)


def q_digest_metadata(spark, sf):
    return _run_gated(spark, sf).digest.drop("items")


def _with_header(items, head, cols):
    """Attach the one-row digest header to every item as scalar subqueries."""
    flat = _flat_items(items)
    h = head.select(F.struct(*cols)).scalar()
    return flat.select("*", *[h[c].alias("digest_title" if c == "title" else c) for c in cols])


def q_digest_basic(spark, sf):
    run = PL.run_digest(fx.labelled_vectors(spark, sf), _protos(spark, sf), AS_OF, eps=EPS, min_samples=MIN_SAMPLES,
                        max_events=MAX_EVENTS)
    return _with_header(run.items, run.digest, ["title", "footer", "total_articles", "total_events"])


def q_digest_gated(spark, sf):
    run = _run_gated(spark, sf)
    return _with_header(run.items, run.digest, ["title", "footer", "total_articles", "total_events", "articles_processed",
                                      "relevant_articles", "irrelevant_articles", "pipeline_version"])


# --------------------------------------------------------------------------- store
def q_article_hash(spark, sf):
    return K.article_hash(_plain(spark, sf)).select("article_id", "title_hash")


def q_store_insert_new(spark, sf):
    batch = fx.articles(spark, sf)
    fresh = K.new_articles(batch, fx.store_articles(spark, sf), RUN_TS)
    return fresh.select("pos", "title_hash", "title", "source", "is_relevant")


def q_store_saved_ids(spark, sf):
    """The stored id of every article of the batch, null for new ones (K2)."""
    return K.saved_ids(fx.articles(spark, sf, with_url=False, with_published=False, with_labels=False),
                       fx.store_articles(spark, sf))


def q_store_digest_record(spark, sf):
    dig = D.digest(_items(spark, sf), AS_OF)
    rec = K.digest_record(dig, {"classification_method": "nearest_prototype", "clustering_eps": EPS,
                                "version": dims.STORE_PIPELINE_VERSION}, RUN_TS)
    return rec.select("language", "events_count", "articles_processed", "pipeline_version",
                      F.col("pipeline_config")["clustering_eps"].alias("clustering_eps"),
                      F.col("digest_data.footer").alias("footer"))


def q_store_mark_processed(spark, sf):
    ids = _classified(spark, sf).select("article_id")
    hist = K.mark_processed(ids, {"classification_method": "nearest_prototype"}, RUN_TS)
    return hist.select("article_id", ts_str("processed_at").alias("processed_at"), "pipeline_version",
                       F.col("pipeline_config")["classification_method"].alias("classification_method"))


def q_store_update_relevance(spark, sf):
    updates = _relevance(spark, sf).select(F.col("article_id").cast("string").alias("id"), "is_relevant",
                                           "relevance_confidence")
    out = K.update_relevance(fx.store_articles(spark, sf), updates, RUN_TS)
    return out.select("id", "is_relevant", r6("relevance_confidence").alias("relevance_confidence"),
                      ts_str("relevance_updated_at").alias("relevance_updated_at"))


def q_store_get_articles(spark, sf):
    out = K.get_articles(fx.store_articles(spark, sf), limit=100, category="quality", source="EXAMPLE",
                         date_from="2024-01-01 06:00:00")
    return out.select("id", "title", ts_str("publish_date").alias("publish_date"))


def q_store_normalize(spark, sf):
    out = K.normalize_store_articles(fx.store_articles(spark, sf))
    return out.select("id", "title", "description", "url", "source", ts_str("published").alias("published"),
                      "language")


def q_store_get_digests(spark, sf):
    out = K.get_digests(fx.digests(spark, sf), limit=10, language="english")
    return out.select("digest_id", ts_str("created_at").alias("created_at"), "language", "events_count")


# --------------------------------------------------------------------------- statistics
def q_stats_totals(spark, sf):
    return T.store_totals(fx.store_articles(spark, sf), fx.digests(spark, sf))


def q_stats_by_category(spark, sf):
    return T.stats_by_category(fx.store_articles(spark, sf))


def q_stats_by_source(spark, sf):
    return T.stats_by_source(fx.store_articles(spark, sf))


def q_run_stats(spark, sf):
    run = _run_gated(spark, sf)
    return T.run_stats(run.collected, run.classified, run.items)


def q_category_counts(spark, sf):
    relevant, _ = R.split_relevance(_run_gated(spark, sf).classified)
    return T.category_counts(relevant, top=5)


def q_method_comparison(spark, sf):
    out = T.method_comparison(fx.method_results(spark, sf))
    return out.select("method", "count", r6("avg_time").alias("avg_time"), "categories_used", "top_category")


def q_method_speed_rank(spark, sf):
    return T.method_speed_rank(fx.method_results(spark, sf)).withColumn("avg_time", r6("avg_time"))


def q_method_diversity_rank(spark, sf):
    return T.method_diversity_rank(fx.method_results(spark, sf))


def q_method_distribution(spark, sf):
    return T.method_distribution(fx.method_results(spark, sf))


def q_method_summary(spark, sf):
    return T.method_summary_long(fx.method_results(spark, sf)).withColumn("avg_time", r6("avg_time"))


def q_method_results(spark, sf):
    av = fx.labelled_vectors(spark, sf)
    protos = _protos(spark, sf)
    methods = {
        "keyword": lambda d: C.classify_keyword(d, dims.FIXTURE_CATEGORY_KEYWORDS),
        "nearest": lambda d: C.classify_nearest(d, protos),
    }
    out = T.run_methods(av, methods)
    return out.select("article_id", "result", "category", r6("confidence").alias("confidence"), "method")


# --------------------------------------------------------------------------- sources, sinks, streaming
def q_feed_scan(spark, sf):
    """Articles landed as RSS files by Spark, then scanned back."""
    from gazette.session import scratch_path
    from gazette.sources import feeds
    path = scratch_path(spark, "feeds")
    feeds.write_feeds(fx.articles(spark, sf, with_published=False, with_labels=False), path)
    out = feeds.read_feeds(spark, path)
    return out.select(F.col("guid").cast("long").alias("article_id"), "source", "title", "description", "url")


def q_feed_collect(spark, sf):
    """Collection (P1-P8) on the scanned feeds, in feed order."""
    from gazette.session import scratch_path
    from gazette.sources import feeds
    path = scratch_path(spark, "feeds")
    feeds.write_feeds(fx.articles(spark, sf, with_published=False, with_labels=False), path)
    arts = feeds.read_feeds(spark, path).join(
        fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("guid"),
                                                F.col("lang").alias("language")), "guid").withColumn(
        "source_ord", F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"))
    return P.collect_pipeline(arts, max_total=100).select(F.col("guid").cast("long").alias("article_id"), "source",
                                                           "title")


def _landed_store(spark, sf):
    """A range store that holds the labelled articles, in a new folder."""
    from gazette.operators.hash_store import HashStore
    from gazette.session import scratch_path
    store = HashStore(spark, scratch_path(spark, "store"), STORE_PREFIX)
    store.load(fx.store_articles(spark, sf))
    return store


def q_ingest_stream(spark, sf):
    """Landed article files ingested by a streaming query into the store (K3)."""
    from gazette.session import scratch_path
    from gazette.streaming.ingest import ingest_stream
    landing, ckpt = (scratch_path(spark, n) for n in ("landing", "stream-ckpt"))
    arts = fx.articles(spark, sf, with_labels=False)
    arts.write.parquet(landing)
    store = _landed_store(spark, sf)
    ingest_stream(spark, landing, arts.schema, store.path, ckpt, prefix=STORE_PREFIX).awaitTermination()
    return store.articles().select("title_hash", "title", "source")


def q_ingest_feeds(spark, sf):
    """Landed RSS files ingested by a streaming query into the store (S1 and K3), in feed order."""
    from gazette.session import scratch_path
    from gazette.sources import feeds
    from gazette.streaming.ingest import ingest_feeds
    landing, ckpt = (scratch_path(spark, n) for n in ("feeds", "stream-ckpt"))
    feeds.write_feeds(fx.articles(spark, sf, with_published=False, with_labels=False), landing)
    store = _landed_store(spark, sf)
    ingest_feeds(spark, landing, store.path, ckpt, prefix=STORE_PREFIX).awaitTermination()
    return store.articles().select("title_hash", "title", "source")


def q_store_ranges(spark, sf):
    """K2 and K6 on the range store: all articles inserted, the computed relevance set, the current rows."""
    store = _landed_store(spark, sf)
    store.insert(fx.articles(spark, sf, with_url=False, with_published=False, with_labels=False), RUN_TS)
    updates = _relevance(spark, sf).select(F.col("article_id").cast("string").alias("id"), "is_relevant", "relevance_confidence")
    store.update_relevance(updates, RUN_TS)
    return store.articles().select("title_hash", "id", "title", "source", "is_relevant", r6("relevance_confidence").alias("relevance_confidence"))


def q_store_ranges_stats(spark, sf):
    """T1-T3 from the counts of the commits, after an insert and an update."""
    store = _landed_store(spark, sf)
    store.insert(fx.articles(spark, sf, with_url=False, with_published=False, with_labels=False), RUN_TS)
    updates = _relevance(spark, sf).select(F.col("article_id").cast("string").alias("id"), "is_relevant", "relevance_confidence")
    store.update_relevance(updates, RUN_TS)
    return store.counts().select("category", "source", "is_relevant", F.col("n").alias("count"))


def q_sink_roundtrip(spark, sf):
    """Classified articles written as CSV and JSON, digest as JSON and text; all of it read back.

    Both files and the digest are made of one stored table, so the articles are classified, and their texts shuffled, once.
    """
    from gazette.session import scratch_path
    from gazette.sinks import files
    base = scratch_path(spark, "sinks")
    scored = _classified(spark, sf)
    stored = G.clustered(scored.withColumn("_found", F.col("category")), EPS, MIN_SAMPLES)   # clustering fills a missing one
    classified = stored.select(*[F.col("_found").alias(c) if c == "category" else c for c in scored.columns if c != "vec"])
    files.write_classified_csv(classified, f"{base}/csv", compression="gzip")
    files.write_classified_json(classified, f"{base}/json", {"method": "nearest_prototype"}, compression="gzip")
    dig = D.digest(_items(spark, sf, members=G.members_of(stored.drop("_found"))), AS_OF)
    files.write_digest(dig, D.render_text(dig), f"{base}/digest")
    csv = spark.read.options(multiLine=True, **files.CSV).csv(f"{base}/csv")
    js = spark.read.json(f"{base}/json/articles")
    own = ("title", "description", "source", "category")
    total = spark.read.json(f"{base}/json/metadata").select("total_articles").scalar()
    text = spark.read.text(f"{base}/digest/text", wholetext=True).select("value").scalar()
    footer = spark.read.json(f"{base}/digest/digest").select("footer").scalar()
    side = lambda df, p: df.select(F.col("article_id").cast("long").alias("article_id"),
                                   *[F.md5(F.coalesce(F.col(c), F.lit(""))).alias(f"{p}_{c}") for c in own])
    return side(csv, "csv").join(side(js, "json"), "article_id").select(
        "*", total.alias("total_articles"), F.contains(text, footer).alias("text_has_footer"))


def q_method_files(spark, sf):
    """Method results and summary written (W5), per-method CSV read back."""
    from gazette.session import scratch_path
    from gazette.sinks import files
    base = scratch_path(spark, "methods")
    mr = fx.method_results(spark, sf)
    files.write_methods(mr, T.method_summary(mr), base)
    return spark.read.option("header", True).csv(f"{base}/by_method").groupBy("method").count()


QUERIES = {
    "collect_cap_per_source": q_collect_cap_per_source,
    "collect_language": q_collect_language,
    "collect_length": q_collect_length,
    "collect_dedup_title": q_collect_dedup_title,
    "collect_pipeline": q_collect_pipeline,
    "collect_report": q_collect_report,
    "compose_text": q_compose_text,
    "lang_detect": q_lang_detect,
    "collect_detected": q_collect_detected,
    "keyword_hits": q_keyword_hits,
    "keyword_hits_lexicon": q_keyword_hits_lexicon,
    "relevance": q_relevance,
    "relevance_split": q_relevance_split,
    "relevance_report": q_relevance_report,
    "classify_keyword": q_classify_keyword,
    "classify_lexicon": q_classify_lexicon,
    "prototypes": q_prototypes,
    "classify_nearest": q_classify_nearest,
    "classify_nearest_table": q_classify_nearest_table,
    "label_top1": q_label_top1,
    "label_from_description": q_label_from_description,
    "vote_weighted": q_vote_weighted,
    "label_from_answer": q_label_from_answer,
    "classify_gated": q_classify_gated,
    "category_rollup": q_category_rollup,
    "training_rows": q_training_rows,
    "tfidf": q_tfidf,
    "classify_nb": q_classify_nb,
    "classify_tfidf_nearest": q_classify_tfidf_nearest,
    "classify_svm": _ml_query("classify_svm"),
    "classify_rf": _ml_query("classify_rf"),
    "classify_soft_vote": _ml_query("classify_soft_vote"),
    "neighbor_pairs": q_neighbor_pairs,
    "dbscan": q_dbscan,
    "dbscan_border": q_dbscan_border,
    "neighbor_pairs_tree": q_neighbor_pairs_tree,
    "dbscan_tree": q_dbscan_tree,
    "clusters": q_clusters,
    "cluster_keywords": q_cluster_keywords,
    "significant_clusters": q_significant_clusters,
    "top_clusters": q_top_clusters,
    "clusters_trimmed": q_clusters_trimmed,
    "cluster_text": q_cluster_text,
    "summary_prompt": q_summary_prompt,
    "fallback_summary": q_fallback_summary,
    "digest_items": q_digest_items,
    "digest": q_digest,
    "digest_text": q_digest_text,
    "digest_metadata": q_digest_metadata,
    "digest_basic": q_digest_basic,
    "digest_gated": q_digest_gated,
    "article_hash": q_article_hash,
    "store_insert_new": q_store_insert_new,
    "store_saved_ids": q_store_saved_ids,
    "store_digest_record": q_store_digest_record,
    "store_mark_processed": q_store_mark_processed,
    "store_update_relevance": q_store_update_relevance,
    "store_get_articles": q_store_get_articles,
    "store_normalize": q_store_normalize,
    "store_get_digests": q_store_get_digests,
    "stats_totals": q_stats_totals,
    "stats_by_category": q_stats_by_category,
    "stats_by_source": q_stats_by_source,
    "run_stats": q_run_stats,
    "category_counts": q_category_counts,
    "method_comparison": q_method_comparison,
    "method_speed_rank": q_method_speed_rank,
    "method_diversity_rank": q_method_diversity_rank,
    "method_distribution": q_method_distribution,
    "method_summary": q_method_summary,
    "method_results": q_method_results,
    "feed_scan": q_feed_scan,
    "feed_collect": q_feed_collect,
    "ingest_stream": q_ingest_stream,
    "ingest_feeds": q_ingest_feeds,
    "store_ranges": q_store_ranges,
    "store_ranges_stats": q_store_ranges_stats,
    "sink_roundtrip": q_sink_roundtrip,
    "method_files": q_method_files,
}
