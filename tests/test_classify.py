"""Classification (C1-C9, C15) on hand-built rows."""

import pytest
from support import rows

from gazette import dims
from gazette.operators import classify as C


def test_keyword_ties_default_and_confidence(spark):
    cats = [("a", ["x", "y"]), ("b", ["x", "z"]), ("c", ["q"])]
    df = spark.createDataFrame([(1, "x"), (2, "z y"), (3, "nothing"), (4, "QQ")], "id long, text string")
    got = rows(C.classify_keyword(df, cats, "text"), "id", "category", "confidence")
    assert got == [(1, "a", 0.5), (2, "a", 0.5), (3, "world", 0.0), (4, "c", 1.0)]


def test_real_dictionaries_substring_semantics(spark):
    df = spark.createDataFrame([(1, "The main story"), (2, "Police arrest the NASA singer")], "id long, text string")
    got = dict(rows(C.classify_keyword(df, dims.CATEGORY_KEYWORDS, "text"), "id", "category"))
    assert got[1] == "technology"      # 'ai' inside 'main'
    assert got[2] == "crime"           # police + arrest beat nasa / singer


def test_nearest_prototype_tie_first_wins(spark):
    protos = [(0, "p0", [1.0, 0.0]), (1, "p1", [0.0, 1.0])]
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id long, vec array<double>")
    got = {r.id: (r.category, round(r.confidence, 6)) for r in C.classify_nearest(df, protos).collect()}
    assert got == {1: ("p0", round(2 ** -0.5, 6)), 2: ("p1", 1.0), 3: ("p0", 0.0)}


def test_prototypes_are_means(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 3.0]), ("a", 0, [3.0, 5.0]), ("b", 1, [0.0, 1.0])],
                               "category string, label int, vec array<double>")
    got = {r.category: list(r.vec) for r in C.build_prototypes(df, "category", "vec", "label").collect()}
    assert got == {"a": [2.0, 4.0], "b": [0.0, 1.0]}


def test_top_label_and_description_map(spark):
    scores = spark.createDataFrame([(1, 0, "x", 0.5), (1, 1, "y", 0.5), (2, 0, "x", 0.1), (2, 1, "y", 0.9)],
                                   "article_id long, ord int, label string, score double")
    assert rows(C.top_label(scores), "article_id", "category") == [(1, "x"), (2, "y")]
    desc = dims.BASIC_CATEGORIES[3][1]
    df = spark.createDataFrame([(1, desc), (2, "unknown text")], "article_id long, category string")
    assert rows(C.label_from_description(df), "article_id", "category") == [(1, "sports"), (2, "world")]


def test_vote_weighted(spark):
    res = spark.createDataFrame([
        (1, "m1", "b", 0.3, 1), (1, "m2", "a", 0.2, 2), (1, "m3", "a", 0.1, 3),   # tie 0.3 vs 0.3 -> b first
        (2, "m1", "a", 0.9, 4), (2, "m2", "b", 0.5, 5), (2, "m3", "b", 0.5, 6),   # b sums 1.0
    ], "article_id long, method string, category string, confidence double, pos long")
    got = {r.article_id: (r.category, round(r.confidence, 6), r.method) for r in C.vote_weighted(res).collect()}
    assert got == {1: ("b", 0.3, "ensemble_3models"), 2: ("b", 0.5, "ensemble_3models")}
    fb = spark.createDataFrame([(3, "world", 0.4, "semantic")], "article_id long, category string, confidence double, method string")
    got = rows(C.vote_weighted(res, fallback=fb), "article_id", "method")
    assert (3, "semantic") in got


def test_label_from_answer(spark):
    df = spark.createDataFrame([(1, "  Sports and POLITICS "), (2, "no idea"), (3, None)], "id long, answer string")
    got = {r.id: (r.category, r.confidence, r.method)
           for r in C.label_from_answer(df, model="vendor/model-x").collect()}
    assert got == {1: ("politics", 0.8, "llm_model-x"), 2: ("world", 0.8, "llm_model-x"),
                   3: ("world", 0.0, "llm_model-x_error")}


def test_gate_then_classify(spark):
    protos = [(0, "p0", [1.0, 0.0]), (1, "p1", [0.0, 1.0])]
    df = spark.createDataFrame([(1, "spam scam fraud " + "w " * 20, [0.0, 1.0]),
                                (2, "market news " + "w " * 20, [0.0, 1.0])], "id long, text string, vec array<double>")
    got = {r.id: (r.is_relevant, r.category, r.confidence)
           for r in C.classify_gated(df, protos, ["spam", "scam", "fraud"], ["market"], text_col="text").collect()}
    assert got[1] == (False, "irrelevant", 0.0) and got[2][:2] == (True, "p1")


def test_main_category_and_rollup(spark):
    df = spark.createDataFrame([("technology_ai",), ("education",), ("nonsense",), ("technology_ai",)], "category string")
    assert rows(C.main_category(df), "category", "main_category")[0] == ("education", "society")
    roll = {(r.main_category, r.sub_category): r.articles for r in C.category_rollup(df).collect()}
    assert roll[("technology", "technology_ai")] == 2 and roll[("other", "nonsense")] == 1
    assert roll[(None, None)] == 4 and roll[("technology", None)] == 2


def test_dispatch_unknown_method(spark):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    with pytest.raises(ValueError):
        C.classify(df, "no_such_method")
    assert C.classify(df, "keyword", text_col="text").count() == 1


def test_training_rows(spark):
    dim = dims.category_table(spark)
    assert C.training_rows(dim, 3).count() == 27
