"""The corpus pipeline: documents to tokens in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and applies one operator of
``gazette.llm`` to all rows that its predecessor kept:

1. ``quality_rules``: documents that the risk-controlled rules reject go;
2. ``near_duplicates``: of linked documents (five-word shingles, Jaccard 0.75)
   the one with the smallest id stays;
3. ``repeated_text``: bytes of 100-byte strings that also start earlier are cut
   out (a character that loses a byte goes whole); every document stays;
4. ``decontamination``: documents that hold a benchmark item go;
5. ``tokens``: the ids of each text, with a check that they decode to it.

All but the last return the columns of ``documents``. Rows without text, with
null columns or with equal ids are handled as the operators say; an empty
table gives an empty result. Rows with equal ids stand or fall together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import decontam, fst_pieces, jaccard_join, quality, suffix_dedup
from gazette.session import ensure_checkpoint_dir, scratch_path, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None            # suffix arrays and piece paths are beyond SQL; tests hold a brute-force version


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = quality.judge(docs, _table(spark, sf_dir, "labels"))
    kept = verdict.filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    groups = jaccard_join.components(docs)
    first = (groups.filter(F.col("component_id").eqNullSafe(F.col("doc_id")))
             .select(F.col("doc_id").alias("_first")).distinct())
    return docs.join(first, docs["doc_id"].eqNullSafe(first["_first"]), "left_semi").select(*COLUMNS)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    marked = docs.select(*COLUMNS, F.col("text").isNull().alias("_null"))
    out = suffix_dedup.deduplicate(marked, keep=["doc_id", "lang", "source", "n_chars", "_null"], with_text=True)
    text = F.when(~F.col("_null"), F.col("kept"))
    return out.select("doc_id", text.alias("text"), "lang", "source",
                      F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_leaks(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    out = fst_pieces.encode(docs, keep=["doc_id", "lang", "source"], check=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "n_fallback", "round_trip", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_text", repeated_text),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
