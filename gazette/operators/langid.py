"""Language identification as a Spark job (P5).

Character-trigram profiles per language are learned from labelled text with
a grouped count (combined map-side), and a text is scored by naive Bayes:
the sum over its trigrams of ``log((count + 1) / (total + V))``. Only trigrams
a language has seen need a join; the rest contribute the per-language
constant (one aggregated row). Trigrams are counted per text before the join,
and the profiles are broadcast up to a checked size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.session import broadcast_if_small, ensure_checkpoint_dir

# every overlapping 3-character substring: a zero-width lookahead match at each
# position captures the next three characters (one compiled regex per text)
_TRIGRAM_RE = r"(?s)(?=(.{3}))"


def trigrams(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    t = df.select(*keep, F.lower(F.col(text_col)).alias("_t"))
    return t.select(*keep, F.explode(F.regexp_extract_all("_t", F.lit(_TRIGRAM_RE), 1)).alias("tri"))


class LangProfiles:
    def __init__(self, counts: DataFrame, langs):
        self.counts = counts      # (lang, tri, lc) with lc = log(count + 1)
        self.langs = langs        # column: array of (lang, log(total + V)) in language order


def lang_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LangProfiles:
    ensure_checkpoint_dir(train.sparkSession)
    tri = trigrams(train, text_col, [F.col(lang_col).alias("lang")])
    counts = tri.groupBy("lang", "tri").agg(F.count("*").alias("c")).checkpoint()
    v = counts.select(F.countDistinct("tri")).scalar()
    totals = (counts.groupBy("lang").agg(F.sum("c").alias("total"))
              .select("lang", F.log(F.col("total") + v).alias("lnorm")))
    langs = totals.agg(F.array_sort(F.collect_list(F.struct("lang", "lnorm"))).alias("langs")).scalar()
    return LangProfiles(counts.select("lang", "tri", F.log(F.col("c") + 1.0).alias("lc")), langs)


def detect_language(df: DataFrame, profiles: LangProfiles, text_col: str = "title",
                    id_col: str = "article_id") -> DataFrame:
    """Adds ``detected`` (argmax language, first in order on ties; null when the text has
    no trigram) and ``score`` (its log-likelihood)."""
    tri = trigrams(df, text_col, [id_col]).groupBy(id_col, "tri").agg(F.count("*").alias("m"))
    n = tri.groupBy(id_col).agg(F.sum("m").alias("n"))
    seen = (tri.join(broadcast_if_small(profiles.counts), "tri").groupBy(id_col, "lang")
            .agg(F.sum(F.col("m") * F.col("lc")).alias("s"))
            .groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("lang", "s"))).alias("smap")))
    scored = (df.join(n, id_col, "left").join(seen, id_col, "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .withColumn("_langs", profiles.langs)
              .withColumn("_b", F.array_max(F.transform("_langs", lambda l, i: F.struct(
                  (F.coalesce(F.try_element_at(F.col("smap"), l["lang"]), F.lit(0.0)) - l["lnorm"] * F.col("n"))
                  .alias("s"), (-i).alias("neg_ord"), l["lang"].alias("lang"))))))
    # a text without a single trigram cannot be identified: no language (collection drops it)
    known = F.col("n") > 0
    return (scored.withColumn("detected", F.when(known, F.col("_b.lang")))
                  .withColumn("score", F.when(known, F.col("_b.s"))).drop("_b", "_langs", "n", "smap"))
