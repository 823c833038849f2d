from gazette.llm import decontam as D

from helpers import edge_rows, frame, leak_pairs

SF = "/root/testdata/sf0.001"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.similarity for r in D.find_leaks(d, b).collect()}


def test_given_documents(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.similarity for r in D.find_leaks(d, b).collect()}
    want = leak_pairs([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_edited_passages(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew some very strong coffee for the long night ahead of them"
    w = item.split()
    docs = [
        (1, f"before it {item} and after"), (2, item.upper().replace(" ", ", ")), (3, " ".join(w[:-2])), (4, " ".join(w[3:]) + " tail end"),
        (5, " ".join(w[:12] + ["extra"] + w[12:])), (6, " ".join(w[::-1])), (7, " ".join(w[:9])), (8, f"{item} {item} {item}"),
        (9, "short text"), (10, "to be or not"),
    ]
    items = [(100, item), (101, "to be or"), (102, ""), (103, None), (104, "unrelated words that occur nowhere else at all")]
    got, want = found(spark, docs, items), leak_pairs(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {(1, 100), (2, 100), (8, 100), (10, 101)} <= got.keys() and (6, 100) not in got


def test_blocks_guarantee_the_radius(spark):
    """Any two fingerprints within the radius agree in a block."""
    from pyspark.sql import functions as F
    rows = spark.range(300).select(F.xxhash64("id").alias("a")).select(
        "a", F.expr(f"aggregate(sequence(1, {D.RADIUS}), a, (f, i) -> f ^ shiftleft(1L, cast(pmod(xxhash64(a, i), 64) AS int)))").alias("b"))
    both = rows.select(F.arrays_overlap(D.blocks("a"), D.blocks("b")).alias("hit"), F.bit_count(F.expr("a ^ b")).alias("d"))
    assert both.filter(F.col("d") > D.RADIUS).count() == 0 and both.filter(~F.col("hit")).count() == 0


def test_edges(spark):
    docs = frame(spark, edge_rows())
    bench = spark.createDataFrame([(1, " ".join(f"word{i % 37} tail{i % 11}" for i in range(30))), (2, None)], "item_id long, text string")
    hit = {r.doc_id for r in D.find_leaks(docs, bench).collect()}
    assert hit == {5, 6, None, 11}
    assert D.remove_leaks(docs, bench).count() == len(edge_rows()) - 5
    assert D.find_leaks(docs.limit(0), bench).count() == 0 and D.find_leaks(docs, bench.limit(0)).count() == 0


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    test_edited_passages(spark)


def test_leaks_cut_at_the_edges_of_a_text(spark):
    item = [f"{'abcdefgh'[i % 8] * (1 + i % 7)}{i}" for i in range(59)]
    other = [f"otherwords{i}" for i in range(80)]
    docs = [(1, " ".join(item[:49] + other)), (2, " ".join(other + item[10:])), (3, " ".join(other[:40] + item[5:54] + other[40:])),
            (4, " ".join(item[8:])), (5, " ".join(item[:25] + ["x"] + item[28:] + other)), (6, " ".join(item[:30] + other))]
    items = [(100, " ".join(item))]
    got, want = found(spark, docs, items), leak_pairs(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {(1, 100), (2, 100)} <= got.keys() and (6, 100) not in got


def test_what_the_radius_keeps(spark):
    """Windows just above the similarity: how many are within the radius of their item's fingerprint."""
    import random

    from pyspark.sql import functions as F
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    items, edited = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(40, 80))]
        items.append((i, " ".join(w)))
        cut = rng.randint(len(w) // 10, len(w) // 7)                      # one end replaced: similarity about 0.75 to 0.82
        edited.append((i, " ".join(w[:-cut] + [word() for _ in range(cut)])))
    side = lambda rows: D.item_table(spark.createDataFrame(rows, "item_id long, text string"))
    a, b = side(items), side(edited).select("item", F.col("sh").alias("sh_b"), F.col("total").alias("t_b"), F.col("fp").alias("fp_b"))
    both = a.join(b, "item").withColumn("shared", D.weight(F.array_intersect("sh", "sh_b")))
    both = both.select((F.col("shared") / (F.col("total") + F.col("t_b") - F.col("shared"))).alias("s"),
                       F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))).alias("d"))
    near = [r.d for r in both.filter("s BETWEEN 0.75 AND 0.82").collect()]
    assert len(near) > 150 and sum(d <= D.RADIUS for d in near) / len(near) >= 0.99
