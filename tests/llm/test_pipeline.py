"""The pipeline against a brute-force version of every stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gazette.llm.oracles import SQL

from helpers import cut_repeats, edge_rows, frame, leak_pairs, near_components

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL['op4_quality_rules']}) WHERE kept").fetchall()}
    rows = sorted(r for r in con.execute("SELECT doc_id, text FROM documents").fetchall() if r[0] in kept)
    rows = [r for r, (_, c) in zip(rows, near_components(rows), strict=True) if c == r[0]]
    rows = [(i, w[4].decode("utf-8", "ignore")) for (i, _), w in zip(rows, cut_repeats(rows), strict=True)]
    leaked = {d for d, _ in leak_pairs(rows, con.execute("SELECT item_id, text FROM benchmark").fetchall())}
    rows = [r for r in rows if r[0] not in leaked]
    out = P.run(spark, SF)
    from gazette.llm import fst_pieces
    got = {r.doc_id: r.decoded for r in fst_pieces.decode(out, keep=["doc_id"]).collect()}
    assert got == dict(rows) and out.filter(~F.col("round_trip")).count() == 0


@pytest.mark.parametrize("rows", [edge_rows(), []])
def test_stages_take_edge_rows(spark, rows):
    docs = frame(spark, rows, False).coalesce(1).checkpoint()
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.collect()
        if name != "tokens":
            assert out.columns == P.COLUMNS and [t for _, t in out.dtypes] == ["bigint", "string", "string", "string", "bigint"]


def test_stages():
    assert 4 <= len(P.STAGES) <= 5 and P.ORACLE_SQL is None
