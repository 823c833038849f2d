"""Clustering (G1-G7): DBSCAN against a brute-force reference, path equivalence, invariants."""

import math

import numpy as np
from support import rows

from gazette.operators import cluster as G
from gazette.operators.components import connected_components


def ref_dbscan(X, eps, min_samples):
    """Brute-force DBSCAN with precomputed cosine distances, scanning points in index order."""
    X = np.asarray(X, dtype=float)
    n = len(X)
    norms = np.linalg.norm(X, axis=1, keepdims=True)
    U = X / np.where(norms == 0, 1, norms)
    D = np.clip(1 - U @ U.T, 0, 2)
    np.fill_diagonal(D, 0)
    neigh = [np.nonzero(D[i] <= eps)[0] for i in range(n)]
    core = [len(nb) >= min_samples for nb in neigh]
    labels = [-1] * n
    c = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if labels[j] == -1:
                labels[j] = c
                if core[j]:
                    stack.extend(k for k in neigh[j] if labels[k] == -1)
        c += 1
    return labels


def angle_vec(deg):
    return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]


def make_df(spark, points):
    """points: list of (category, pos, vec)."""
    data = [(c, p, f"title {p}", "desc", f"s{p % 3}", v) for c, p, v in points]
    return spark.createDataFrame(data, "category string, pos long, title string, description string, "
                                       "source string, vec array<double>")


def expected(points, eps, ms):
    out = {}
    cats = sorted(set(c for c, _, _ in points))
    for c in cats:
        pts = sorted([(p, v) for cc, p, v in points if cc == c])
        if len(pts) < ms:
            out.update({p: (0, True) for p, _ in pts})
            continue
        lab = ref_dbscan([v for _, v in pts], eps, ms)
        out.update({p: (l, l == -1) for (p, _), l in zip(pts, lab)})
    return out


def random_points(seed=7, n_cat=3, per_cat=60, dim=8):
    rng = np.random.default_rng(seed)
    pts, pos = [], 0
    for c in range(n_cat):
        centers = rng.normal(size=(4, dim))
        for _ in range(per_cat):
            v = centers[rng.integers(4)] + rng.normal(scale=0.35, size=dim)
            pts.append((f"c{c}", pos, [float(x) for x in v]))
            pos += 1
    return pts


def test_dbscan_matches_reference_random(spark):
    pts = random_points()
    df = make_df(spark, pts)
    for eps, ms in [(0.05, 2), (0.08, 3), (0.1, 5)]:
        got = {r.pos: (r.cluster_id, r.is_noise) for r in G.cluster_members(df, eps, ms).collect()}
        assert got == expected(pts, eps, ms), (eps, ms)


def test_border_point_between_two_clusters(spark):
    a = [0, 0.5, 1, 1.5, 2]
    b = [8, 8.5, 9, 9.5, 10]
    pts = [("x", i, angle_vec(d)) for i, d in enumerate(a)] + [("x", 10, angle_vec(5))] + \
          [("x", 20 + i, angle_vec(d)) for i, d in enumerate(b)]
    eps = 1 - math.cos(math.radians(3.2))
    got = {r.pos: r.cluster_id for r in G.cluster_members(make_df(spark, pts), eps, 4).collect()}
    assert got[10] == 0 and got[0] == 0 and got[20] == 1
    assert got == {p: v[0] for p, v in expected(pts, eps, 4).items()}


def test_exact_eps_zero_vector_and_single_article(spark):
    pts = [("x", 1, [1.0, 0.0]), ("x", 2, [0.0, 1.0]), ("x", 3, [0.0, 0.0]), ("solo", 4, [1.0, 1.0])]
    df = make_df(spark, pts)
    got = {r.pos: (r.cluster_id, r.is_noise) for r in G.cluster_members(df, 1.0, 2).collect()}
    # distance exactly eps counts; the zero vector has distance 1 to both others
    assert got == expected(pts, 1.0, 2) and got[1] == (0, False) and got[4] == (0, True)
    got = {r.pos: (r.cluster_id, r.is_noise) for r in G.cluster_members(df, 0.999, 2).collect()}
    assert got[1] == (-1, True) and got[3] == (-1, True)
    table = {r.category: r for r in G.clusters(G.cluster_members(df, 1.0, 2)).collect()}
    assert table["solo"].main_source is None and table["solo"].main_title == "title 4"


def test_equal_ids_in_two_categories(spark):
    """Pairs a(1,2) and b(2,3): each id is labelled in its own category."""
    pts = [("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.01]), ("a", 3, [0.0, 1.0]),
           ("b", 1, [0.0, 1.0]), ("b", 2, [1.0, 0.0]), ("b", 3, [1.0, 0.01])]
    got = {(r.category, r.pos): r.cluster_id for r in G.cluster_members(make_df(spark, pts), 0.1, 2).collect()}
    assert got == {("a", 1): 0, ("a", 2): 0, ("a", 3): -1, ("b", 1): -1, ("b", 2): 0, ("b", 3): 0}


def test_labels_do_not_depend_on_blocks(spark):
    """Small blocks (many tiles, some skipped by their angles) and ids over many rank buckets give the same labels."""
    pts = [(c, p * 70_001, v) for c, p, v in random_points(seed=13)]
    df = make_df(spark, pts)
    for eps, ms in [(0.08, 2), (0.08, 3), (0.6, 4), (1.0, 2)]:
        for block in (7, 100_000):
            got = {r.pos: (r.cluster_id, r.is_noise) for r in G.cluster_members(df, eps, ms, block_size=block).collect()}
            assert got == expected(pts, eps, ms), (eps, ms, block)


def test_missing_vectors_and_categories(spark):
    pts = [("x", 1, [1.0, 0.0]), ("x", 2, [1.0, 0.0]), ("x", 3, None), (None, 4, [1.0, 0.0]), (None, 5, None)]
    got = {r.pos: (r.category, r.cluster_id, r.is_noise) for r in G.cluster_members(make_df(spark, pts), 0.1, 2).collect()}
    assert got == {1: ("x", 0, False), 2: ("x", 0, False), 3: ("x", -1, True), 4: ("unknown", -1, True), 5: ("unknown", -1, True)}
    assert G.cluster_members(make_df(spark, pts).limit(0), 0.1, 2).count() == 0


def test_neighbor_pairs_block_tiles_equal_single_tile(spark):
    df = make_df(spark, random_points(seed=3, per_cat=40))
    one = rows(G.neighbor_pairs(df, 0.1, block_size=10_000), "category", "a", "b")
    many = rows(G.neighbor_pairs(df, 0.1, block_size=7), "category", "a", "b")
    assert one == many and len(one) > 0


def test_tree_prunes_tiles_of_clustered_vectors(spark):
    """Tight clusters in 32 dimensions: same pairs and labels as one block, from a fraction of the tiles."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(40, 32))
    pts = [("x", i, [float(x) for x in centers[i % 40] + rng.normal(scale=0.05, size=32)]) for i in range(1600)]
    pts += [("y", 5000 + i, [float(x) for x in rng.normal(size=32)]) for i in range(30)]
    df = make_df(spark, pts)
    eps = 0.02
    tiles = {r.category: r for r in G.tile_counts(df, eps, block_size=40).collect()}
    assert tiles["y"].tiles == tiles["y"].all_pairs == 1
    assert tiles["x"].blocks >= 40 and tiles["x"].tiles < 0.15 * tiles["x"].all_pairs
    small = rows(G.neighbor_pairs(df, eps, block_size=40), "category", "a", "b")
    assert small == rows(G.neighbor_pairs(df, eps, block_size=10_000), "category", "a", "b") and len(small) > 10_000
    for ms in (2, 4):
        got = {r.pos: (r.cluster_id, r.is_noise) for r in G.cluster_members(df, eps, ms, block_size=40).collect()}
        assert got == expected(pts, eps, ms)


def test_tree_without_separation(spark):
    """Equal vectors, zero vectors and eps beyond 1 leave nothing to prune, and nothing is lost."""
    pts = [("x", i, [1.0, 0.0, 0.0]) for i in range(60)] + [("x", 100 + i, [0.0, 0.0, 0.0]) for i in range(20)]
    pts += [("x", 200 + i, angle_vec(i * 4) + [0.1 * (i % 3)]) for i in range(80)]
    df = make_df(spark, pts)
    for eps, ms in [(0.01, 3), (1.0, 2), (1.2, 5)]:
        got = {r.pos: (r.cluster_id, r.is_noise) for r in G.cluster_members(df, eps, ms, block_size=9).collect()}
        assert got == expected(pts, eps, ms), (eps, ms)
    equal = make_df(spark, pts[:60])
    assert G.neighbor_pairs(equal, 0.1, block_size=7).count() == 60 * 59 // 2


def test_invariants_and_repartition(spark):
    pts = random_points(seed=5)
    df = make_df(spark, pts)
    m1 = G.cluster_members(df, 0.08, 2)
    assert m1.count() == len(pts) and m1.select("pos").distinct().count() == len(pts)
    table = G.clusters(m1)
    assert table.agg({"size": "sum"}).collect()[0][0] == len(pts)
    m2 = G.cluster_members(df.repartition(7), 0.08, 2)
    assert rows(m1, "pos", "cluster_id") == rows(m2, "pos", "cluster_id")


def test_keywords(spark):
    data = [("k", 0, 1, "Alpha betas, the", "alpha with betas gamma"),
            ("k", 0, 2, "betas gamma", "word1 abc"),
            ("k", 1, 3, "a an to", "x1 y2")]
    m = spark.createDataFrame(data, "category string, cluster_id long, pos long, title string, description string")
    got = {r.cluster_id: list(r.keywords) for r in G.cluster_keywords(m).collect()}
    # 'betas,' carries punctuation; alpha and betas tie at 2, alpha came first
    assert got == {0: ["alpha", "betas", "gamma"], 1: ["news"]}


def test_top_clusters_order(spark):
    t = spark.createDataFrame([("b", 0, 3, False, 5), ("a", 1, 3, False, 1), ("a", 0, 3, False, 1),
                               ("a", -1, 9, True, 1), ("c", 0, 1, False, 2), ("d", 0, 4, False, 9)],
                              "category string, cluster_id long, size long, is_noise boolean, cat_first long")
    got = rows(G.top_clusters(t, n=3), "rank", "category", "cluster_id")
    assert got == [(1, "d", 0), (2, "a", 0), (3, "a", 1)]
    sig = dict(rows(G.significant_clusters(t), "category", "significant"))
    assert sig == {"a": 2, "b": 1, "c": 0, "d": 1}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (205, 200), (200, 201), (200, 202)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(rows(connected_components(df), "id", "root"))
    assert all(got[i] == 1 for i in range(1, 41))
    assert got[101] == 100 and got[205] == 200 and got[202] == 200 and len(got) == 46


def test_small_leaves_are_laid_in_bundles(spark):
    from gazette.operators import metric_tree
    rng = np.random.default_rng(3)
    m = rng.normal(size=(2600, 3))
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(m.tolist())], "category string, pos long, vec array<double>")
    points = df.toDF("k", "id", "v").checkpoint()
    bundles = metric_tree.build(points, 8).bundles()
    sizes = [r["count"] for r in bundles.rows.groupBy("blk").count().collect()]
    assert sum(sizes) == 2600 and max(sizes) <= metric_tree.BUNDLE and len(sizes) <= metric_tree.FANOUT
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(1.0 - u @ u.T <= 0.001, 1))
    got = {(r.a, r.b) for r in G.neighbor_pairs(df, 0.001, block_size=8).select("a", "b").collect()}
    assert got == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) > 500


def test_keywords_take_one_shuffle_of_words_for_ids_of_31_bits(spark):
    texts = ["gamma alpha beta beta", "delta alpha gamma", "omega delta"]

    def made(shift):
        df = spark.createDataFrame([("k", 0, i + shift, t, None) for i, t in enumerate(texts)],
                                   "category string, cluster_id long, pos long, title string, description string")
        return G.cluster_keywords(df, stop_words=["stop"])

    small, large = made(0), made(1 << 40)
    assert small.first()["keywords"] == large.first()["keywords"] == ["gamma", "alpha", "beta", "delta", "omega"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(small).count("Exchange hashpartitioning") < plan(large).count("Exchange hashpartitioning")


def test_rows_are_copied_by_panel_not_by_tile(spark, monkeypatch):
    """Many small blocks: labels as by brute force, and a row goes to no more tasks than its key has panels, and one."""
    from gazette.operators import metric_tree
    monkeypatch.setattr(metric_tree, "BUNDLE", 9)
    monkeypatch.setattr(G, "PANELS", 3)
    pts = [(c, p * 70_001, v) for c, p, v in random_points(seed=17, per_cat=90)] + [("solo", 7, angle_vec(3)), ("c0", 8, None)]
    pts += [("zero", 100 + i, [0.0, 0.0]) for i in range(12)]
    df = make_df(spark, pts)
    for eps, ms in [(0.08, 2), (0.05, 3), (0.6, 4), (1.0, 2)]:
        got = {r.pos: (r.cluster_id, r.is_noise) for r in G.cluster_members(df, eps, ms, block_size=7).collect()}
        assert got == expected([p for p in pts if p[2]], eps, ms) | {8: (-1, True)}, (eps, ms)
    blocks = G._blocks(df, "category", "pos", "vec", 7).bundles()
    tiles = blocks.tiles(0.6)
    place, pairs = G._panels(blocks, tiles)
    n = {r.k: r["count"] for r in blocks.rows.groupBy("k").count().collect()}
    copies = {r.k: r["count"] for r in G._in_pairs(blocks.rows, place).groupBy("k").count().collect()}
    laid = {r.k: r["count"] for r in G._tile_rows(blocks.rows, tiles).groupBy("k").count().collect()}
    assert n.keys() == copies.keys() and all(copies[k] <= n[k] * (G.PANELS + 1) for k in n)
    assert copies["c0"] * 2 < laid["c0"]                       # what one task for each tile takes
    assert pairs.count() == pairs.select("k", "lo", "hi").distinct().count() == tiles.count()
    monkeypatch.setattr(G, "PANEL_BYTES", 8 * 8 * 10)          # ten vectors
    assert rows(G.dbscan_labels(df, 0.05, 3, block_size=7)) == rows(G.dbscan_labels(df, 0.05, 3, block_size=1000))


def test_texts_are_shuffled_and_stored_once(spark, monkeypatch):
    kept = []

    def keep(df, name, real=G._kept):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        kept.append((df.columns, [p for p in plan.split("\n\n") if ") Exchange" in p and "description" in p]))
        return real(df, name)

    monkeypatch.setattr(G, "_kept", keep)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make_df(spark, random_points(seed=2, n_cat=2, per_cat=20))
        df = df.drop("vec", "category").join(df.select("pos", "vec", "category"), "pos", "left")
        df.count()
        members = G.cluster_members(df, 0.08, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert members.count() == 40
    assert sum("description" in columns for columns, _ in kept) == 1
    # by the id, and by nothing else but the few keys whose sizes are broadcast on any table of many rows
    assert [sum("hashpartitioning(pos" in p for p in exchanges) for _, exchanges in kept] == [0, 1]


def test_equal_keys_and_ids_stay_members_of_each_other(spark):
    pts = [("x", 1, [1.0, 0.0]), ("x", 1, [0.0, 1.0]), ("x", 2, [1.0, 0.01]), ("x", 2, None), ("y", 2, [1.0, 0.0])]
    df = make_df(spark, pts).unionByName(spark.sql("SELECT 'x' category, NULL pos, 't' title, 'd' description, 's' source, NULL vec"))
    table = G.clustered(df, 0.1, 2)
    got = sorted((r.category, r.pos or 0, r.vec is None, r.cluster_id, r.times) for r in table.collect())
    assert got == [("x", 0, True, -1, 1), ("x", 1, False, 0, 2), ("x", 1, False, 0, 2), ("x", 2, False, 0, 1), ("x", 2, True, 0, 1), ("y", 2, False, 0, 1)]
    members = G.members_of(table)
    assert sorted((r.category, r.pos or 0) for r in members.collect()) == [("x", 0)] + [("x", 1)] * 4 + [("x", 2)] * 2 + [("y", 2)]
    assert members.columns == ["category", "pos", "title", "description", "source", "vec", "cluster_id", "cat_first", "small", "is_noise"]
