"""RSS feed files as a source (S1) and a writer that lands articles as feeds.

Reading (as a table or as a stream): every landed file is one text row; its ``<item>`` elements are split
out in document order and each is parsed with Spark's built-in ``from_xml``.
The order key is (chunk, file, item index), so "first N entries of a source"
keeps feed order. A feed file is a natural, bounded unit (one fetch).

Writing: the articles of a source fill files of ``items_per_file`` items in ``pos``
order, so files are as many as the articles need and no group grows with the data. Each
item names its chunk, which is ``pos`` by ``items_per_file``; items of other feeds have
the chunk of their folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.functions.text import trim_ws

ITEM_SCHEMA = "title string, description string, link string, guid string, chunk string"
NO_CHUNK = "none"            # chunk of an article without ``pos``
SPAN = 8192                  # positions whose articles are ranked in one group
# an item ends at its end tag outside CDATA sections
ITEM_RE = (r"(?s)<item(?:\s[^>]*)?>(?:[^<]++|<!\[CDATA\[.*?\]\]>|<(?!/item>|!\[CDATA\[))*+</item>"
           r"|<item(?:\s[^>]*)?/>")
# characters XML 1.0 cannot carry; a feed never contains them
INVALID_XML = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"
XML_OPTIONS = {"rowTag": "item", "ignoreSurroundingSpaces": "false"}


def xml_safe(c):
    return F.regexp_replace(c, INVALID_XML, "")


def read_feeds(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Articles from landed feed files below ``path``.

    With ``source`` a plain folder (or file) of that source's feeds; without it
    the layout ``source=<name>/chunk=<n>/``.

    Columns: ``source, pos`` (order key), ``title, description`` (stripped,
    missing -> ''), ``url`` (link as is, missing -> ''), ``guid``.
    """
    return _articles(spark.read.text(path, wholetext=True), source)


def stream_feeds(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The same columns from feed files as they land: a streaming frame with one offset per landed file.

    Spark's file source lists and reads the files (any file system that Spark
    reaches) and keeps the list of those processed in the query's checkpoint.
    The layout ``source=<name>/chunk=<n>/`` must have its first folder when the query starts.
    """
    return _articles(spark.readStream.text(path, wholetext=True), source)


def _articles(raw: DataFrame, source: str | None) -> DataFrame:
    if source is not None:
        raw = raw.select("value", F.lit(source).alias("source"), F.lit(0).alias("chunk"))
    items = raw.select("source", "chunk", F.input_file_name().alias("_file"),
                       F.posexplode(F.regexp_extract_all("value", F.lit(ITEM_RE), 0)).alias("idx", "xml"))
    parsed = items.withColumn("r", F.from_xml("xml", ITEM_SCHEMA, XML_OPTIONS))
    return parsed.select(
        F.col("source").cast("string").alias("source"),
        F.struct(F.when(F.col("r.chunk").isNull(), F.col("chunk").cast("long")).otherwise(F.col("r.chunk").try_cast("long"))
                 .alias("chunk"), "_file", F.col("idx").cast("long").alias("idx"))
        .alias("pos"),
        trim_ws(F.coalesce("r.title", F.lit(""))).alias("title"),
        trim_ws(F.coalesce("r.description", F.lit(""))).alias("description"),
        F.coalesce("r.link", F.lit("")).alias("url"),
        F.col("r.guid").alias("guid"),
    )


def write_feeds(df: DataFrame, path: str, items_per_file: int = 100, id_col: str = "article_id",
                mode: str = "overwrite") -> None:
    """Land articles as RSS files of ``items_per_file`` items of a source (its last file: at most), in ``pos`` order."""
    order = F.floor(F.col("pos") / items_per_file).cast("long")
    item = F.to_xml(F.struct(xml_safe(F.col("title")).alias("title"),
                             xml_safe(F.col("description")).alias("description"),
                             xml_safe(F.col("url")).alias("link"),
                             F.col(id_col).cast("string").alias("guid"),
                             F.coalesce(order.cast("string"), F.lit(NO_CHUNK)).alias("chunk")), XML_OPTIONS)
    span = F.floor(F.col("pos") / SPAN).cast("long").alias("_span")
    # the place of an article in its source: those of the spans before, and its rank in its own
    sizes = df.groupBy(F.col("source").alias("_source"), span.alias("_of")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_source").orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.select("_source", "_of", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("source", "_span").orderBy("pos", "xml"))
    ranked = df.select("source", "pos", span, item.alias("xml")).withColumn("_rank", rank)
    ranked = ranked.join(before, F.col("source").eqNullSafe(F.col("_source")) & F.col("_span").eqNullSafe(F.col("_of")))
    number = F.floor((F.col("_before") + F.col("_rank") - 1) / items_per_file).cast("long")
    # folders of equal width: files of a source sort as they were filled
    files = (ranked.select("source", F.format_string("%012d", number).alias("chunk"), "pos", "xml").groupBy("source", "chunk")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "xml"))).alias("_items"))
             .select("source", "chunk",
                     F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>'),
                              xml_safe(F.col("source")), F.lit("</title>\n"),
                              F.array_join(F.transform("_items", lambda s: s["xml"]), "\n"),
                              F.lit("\n</channel></rss>\n")).alias("value")))
    files.write.mode(mode).partitionBy("source", "chunk").text(path)
