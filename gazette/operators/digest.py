"""Digest (D1-D7): cluster text, prompts, fallback summaries, items, header, text, metadata.

Everything per cluster is bounded before it is gathered: the cluster text can
use at most ``max_length / 38 + 1`` articles (a block is never shorter than 38
characters), so only that many first members per cluster are kept by a
top-k window (WindowGroupLimit) before the running length sum; distinct
sources are counted by aggregation and only three are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette import dims
from gazette.functions.text import sql_str, trim_ws

KEY = ["category", "cluster_id"]
_MIN_BLOCK = len("Article 1 ():\nTitle: \nDescription: \n\n")


def _block(i, source, title, description):
    return F.concat(F.lit("Article "), i.cast("string"), F.lit(" ("), F.coalesce(source, F.lit("unknown")),
                    F.lit("):\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nDescription: "),
                    F.coalesce(description, F.lit("")), F.lit("\n\n"))


# --------------------------------------------------------------------------- D1
def cluster_text(members: DataFrame, max_length: int = 2000, key=KEY, id_col: str = "pos") -> DataFrame:
    """``(key, cluster_text)``: numbered article blocks within a character budget.

    Blocks are added in article order while the total stays within
    ``max_length``; the first block that overflows is cut to the remaining
    space plus ``...\\n`` if more than 100 characters remain; then stop. The
    result is stripped.
    """
    cap = max_length // _MIN_BLOCK + 2
    w = Window.partitionBy(*key).orderBy(id_col)
    firsts = (members.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= cap)
              .withColumn("blk", _block(F.col("i"), F.col("source"), F.col("title"), F.col("description")))
              .withColumn("len", F.length("blk")))
    run = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = firsts.withColumn("upto", F.sum("len").over(run)).withColumn("before", F.col("upto") - F.col("len"))
    firsts = firsts.withColumn("first_over", F.min(F.when(F.col("upto") > max_length, F.col("i")))
                               .over(Window.partitionBy(*key)))
    remaining = F.lit(max_length) - F.col("before")
    piece = (F.when(F.col("first_over").isNull() | (F.col("i") < F.col("first_over")), F.col("blk"))
              .when((F.col("i") == F.col("first_over")) & (remaining > 100),
                    F.concat(F.expr(f"substring(blk, 1, {max_length} - before)"), F.lit("...\n"))))
    pieces = firsts.withColumn("piece", piece).filter(F.col("piece").isNotNull())
    return (pieces.groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("i", "piece"))).alias("_p"))
            .select(*key, trim_ws(F.array_join(F.transform("_p", lambda s: s["piece"]), "")).alias("cluster_text")))


# --------------------------------------------------------------------------- D2
def summary_prompt(texts: DataFrame, language: str = "english", text_col: str = "cluster_text") -> DataFrame:
    """System and user prompt per cluster; the model call is left to the caller."""
    lang = "russian" if language == "russian" else "english"
    return (texts.withColumn("system_prompt", F.lit(dims.SYSTEM_PROMPT[lang]))
                 .withColumn("user_prompt", F.concat(F.lit(dims.USER_PROMPT_HEAD), F.col(text_col),
                                                     F.lit(dims.USER_PROMPT_TAIL[lang]))))


# --------------------------------------------------------------------------- sources per cluster
def cluster_sources(members: DataFrame, key=KEY, keep: int = 3) -> DataFrame:
    """``(key, n_sources, sources)``: distinct non-empty source count, first ``keep`` distinct sources (sorted, '' kept)."""
    distinct = members.groupBy(*key, F.coalesce("source", F.lit("")).alias("src")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*key).orderBy("src")
    first = (distinct.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
             .groupBy(*key).agg(F.array_sort(F.collect_list("src")).alias("sources")))
    counts = distinct.groupBy(*key).agg(F.count_if(F.col("src") != "").cast("long").alias("n_sources"))
    return counts.join(first, key)


# --------------------------------------------------------------------------- D3
def fallback_summary(df: DataFrame, language: str = "english") -> DataFrame:
    """Template summary from ``n_sources, main_title, keywords, size``; an empty cluster has its own text."""
    lang = "russian" if language == "russian" else "english"
    one, many, kw_one, kw_many, empty = dims.FALLBACK_TEMPLATES[lang]
    kw = F.array_join(F.slice(F.col("keywords"), 1, 3), ", ")
    has_kw = F.size(F.col("keywords")) > 0
    title = F.coalesce(F.col("main_title"), F.lit("News"))

    def fill(template, kw_default, n=None):
        head, rest = template.split("{title}")
        head = head.replace("{n}", "%s") if n is not None else head
        rest_a, rest_b = rest.split("{kw}")
        parts = [F.lit(head) if n is None else F.format_string(head, n.cast("string")), title, F.lit(rest_a),
                 F.when(has_kw, kw).otherwise(F.lit(kw_default)), F.lit(rest_b)]
        return F.concat(*parts)

    text = (F.when(F.coalesce(F.col("size"), F.lit(0)) == 0, F.lit(empty))
             .when(F.col("n_sources") <= 1, fill(one, kw_one))
             .otherwise(fill(many, kw_many, F.col("n_sources"))))
    return df.withColumn("fallback", text)


# --------------------------------------------------------------------------- D4
def digest_items(top: DataFrame, members: DataFrame, max_items: int = 5, language: str = "english",
                 summaries: DataFrame | None = None) -> DataFrame:
    """Items for the first ``max_items`` clusters of ``top`` (ranked) with a non-empty summary.

    ``summaries`` (key, summary) from a model may be supplied; missing ones use
    the fallback template. ``source_count`` is the cluster size.
    """
    chosen = top.filter(F.col("rank") <= max_items)
    src = cluster_sources(members.join(chosen.select(*KEY), KEY, "left_semi"))
    items = fallback_summary(chosen.join(src, KEY, "left"), language)
    if summaries is not None:
        items = items.join(summaries, KEY, "left").withColumn("summary", F.coalesce("summary", "fallback"))
    else:
        items = items.withColumn("summary", F.col("fallback"))
    items = items.filter(F.col("summary").isNotNull() & (F.col("summary") != ""))
    return items.select("rank", F.coalesce("main_title", F.lit("No title")).alias("title"), "summary", "category",
                        F.col("size").alias("source_count"), "keywords",
                        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "cluster_id")


# --------------------------------------------------------------------------- D5
def digest(items: DataFrame, as_of: str, language: str = "english") -> DataFrame:
    """One-row digest header: title, date, footer, language, totals, items in rank order."""
    lang = "russian" if language == "russian" else "english"
    title = dims.DIGEST_TITLE[lang].format(date=as_of)
    agg = items.agg(F.coalesce(F.sum("source_count"), F.lit(0)).cast("long").alias("total_articles"),
                    F.count("*").alias("total_events"),
                    F.array_sort(F.collect_list(F.struct("rank", "title", "summary", "category", "source_count",
                                                         "keywords", "sources"))).alias("items"))
    foot = dims.DIGEST_FOOTER[lang]
    head, rest = foot.split("{articles}")
    mid, tail = rest.split("{events}")
    return agg.select(F.lit(title).alias("title"), F.lit(as_of).alias("date"),
                      F.concat(F.lit(head), F.col("total_articles").cast("string"), F.lit(mid),
                               F.col("total_events").cast("string"), F.lit(tail)).alias("footer"),
                      F.lit(language).alias("language"), "total_articles", "total_events", "items")


# --------------------------------------------------------------------------- D6
def render_text(dig: DataFrame) -> DataFrame:
    """Messenger text of a digest row: bold title, numbered items with emoji, sources line, footer."""
    emoji = F.expr("map(" + ", ".join(f"{sql_str(c)}, {sql_str(e)}" for c, e in dims.CATEGORY_EMOJI) + ")")

    def item_text(x):
        t = x["title"]
        short = F.concat(F.substring(t, 1, 60), F.when(F.length(t) > 60, F.lit("...")).otherwise(F.lit("")))
        head = F.concat(F.coalesce(F.try_element_at(emoji, x["category"]), F.lit(dims.DEFAULT_EMOJI)), F.lit(" *"),
                        x["rank"].cast("string"), F.lit(". "), short, F.lit("*"))
        src = F.when(F.size(x["sources"]) > 0,
                     F.concat(F.lit("\n📡 _"), F.array_join(x["sources"], ", "), F.lit("_"))).otherwise(F.lit(""))
        return F.concat(head, F.lit("\n"), x["summary"], src, F.lit("\n\n"))

    # items carry their rank; renumber 1..n in order, as the text enumerates them
    numbered = F.transform("items", lambda x, i: x.withField("rank", (i + 1).cast("long")))
    body = F.array_join(F.transform(numbered, item_text), "")
    return dig.select(F.concat(F.lit("*"), F.col("title"), F.lit("*\n\n"), body,
                               F.lit("_"), F.col("footer"), F.lit("_")).alias("text"))


# --------------------------------------------------------------------------- D7
def digest_metadata(dig: DataFrame, classified: DataFrame, version: str = dims.STORE_PIPELINE_VERSION) -> DataFrame:
    """Digest row plus processed / relevant / irrelevant counts and pipeline version."""
    flag = F.coalesce(F.col("is_relevant"), F.lit(True))
    # one single-row aggregate, attached as one struct-valued scalar subquery (no join)
    counts = classified.select(F.struct(F.count("*").alias("articles_processed"),
                                        F.count_if(flag).alias("relevant_articles"),
                                        F.count_if(~flag).alias("irrelevant_articles"))).scalar()
    return dig.select("*", counts["articles_processed"].alias("articles_processed"),
                      counts["relevant_articles"].alias("relevant_articles"),
                      counts["irrelevant_articles"].alias("irrelevant_articles"),
                      F.lit(version).alias("pipeline_version"))
