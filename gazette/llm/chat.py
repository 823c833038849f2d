"""Chat formatting with Spark expressions only (no Python on the data path).

Template: each run of adjacent turns with one role becomes

    <|im_start|>ROLE<|im_sep|>TEXT<|im_next|>TEXT ... <|im_end|>\\n

Inside roles and texts, ``<`` + n backslashes + ``|`` (n >= 0) is written with
one backslash more, so no control string can appear there and unescaping is
exact. The output is an array of segments ``(text, loss)``: their
concatenation is the formatted conversation, and the segments with ``loss``
are the assistant texts, each once.

``collect_list`` is aggregated map-side and holds one conversation, which is
also one output value by definition; conversations are dealt by ``conv_id``.

Defined results: null text and null role are empty strings; null ``conv_id``
is one conversation; turns with equal (or null) numbers are ordered by
(turn, role, text), nulls first; repeated rows stay; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``conv, segments`` with ``segments: array<struct<text string, loss boolean>>``."""
    # runs of one role: positions where a run starts, then one slice per run
    grouped = turns.select(
        F.col(conv).alias("_c"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("_t"),
    ).groupBy("_c").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    starts = grouped.withColumn("_s", F.expr(
        "filter(sequence(1, size(_t)), i -> i = 1 OR get(_t, i - 1).role <> get(_t, i - 2).role)"))
    runs = starts.select("_c", F.expr(
        "transform(_s, (s, k) -> slice(_t, s, coalesce(get(_s, k + 1), size(_t) + 1) - s))").alias("_runs"))

    def run_segments(run: Column) -> Column:
        name = F.get(run, 0)["role"]
        head = F.struct(F.concat(F.lit(START), escape(name), F.lit(SEP)).alias("text"), F.lit(False).alias("loss"))
        body = F.flatten(F.transform(run, lambda t, i: F.array(
            F.struct(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (name == F.lit(loss_role)).alias("loss")))))
        tail = F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), body, F.array(tail))

    return runs.select(F.col("_c").alias(conv), F.flatten(F.transform("_runs", run_segments)).alias("segments"))


def formatted(segments: str | Column = "segments") -> Column:
    """The conversation as one string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse_turns(text: Column) -> Column:
    """Turns ``array<struct<role, text>>`` read back from a formatted conversation."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(START) + 1, 2**31 - 1), r"<\|im_sep\|>")
        return F.transform(F.split(F.get(parts, 1), r"<\|im_next\|>"), lambda t: F.struct(
            unescape(F.get(parts, 0)).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest_columns(formatted_df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests, all read back from ``segments``."""
    d = formatted_df.select(F.col(conv), formatted().alias("_f"),
                            F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                                     lambda s: unescape(s["text"])), "").alias("_loss"))
    d = d.withColumn("_turns", parse_turns(F.col("_f")))
    flat = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(conv, F.size("_turns").cast("long").alias("n_turns"),
                    F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("_f").cast("long").alias("formatted_chars"))
