"""Quality rules with risk-controlled thresholds (DataFrame expressions only).

Every document gets counts from its whole text and, from them, five badness
scores (``RULES``). The rules tighten together over the levels of fixed ladders
(``LADDERS``): at each level a document is rejected if any score is above its
cutoff of that level, so each level rejects what the one before it does and more.

Labelled documents are the holdout. For each stratum (language) and level the
false rejections of this verdict among good documents are tested against
``ALPHA``: the exact binomial tail ``P(Bin(n, ALPHA) <= k)``, which is the same as
the Clopper-Pearson upper bound of the false-rejection rate staying below
``ALPHA``. Within a stratum the levels are tested in order, from the loosest on,
each at the whole level of the stratum, until the first that fails (a
fixed-sequence test, which needs no further correction); the strata share
``DELTA`` evenly (Bonferroni). So with probability ``1 - DELTA`` the verdict of every
stratum, all five rules together, rejects at most ``ALPHA`` of its good documents.
Among the certified levels the one with the largest ``bad rejected - GOOD_COST *
good rejected`` is taken, the loosest on a tie; a stratum without a certified
level of positive gain rejects nothing beyond the base rule. A stratum needs
``ln(DELTA / strata) / ln(1 - ALPHA)`` good documents to certify anything: 217 with
four strata.

Scale: one pass over the texts, no shuffle of words: repeated 3-word windows
are found inside the row by sorting (hash, position). The slim counts are
checkpointed once; the holdout table has one row per stratum.

Defined results: null or blank text has zero words and fails the base rule;
null language is the stratum ``und``; a document with several labels counts as
good only if all say so; null labels are no labels; repeated rows each get
their row; extra columns are ignored; without labels only the base rule works.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.session import ensure_checkpoint_dir

WS = " \t\n\x0b\x0c\r"                     # [\x20\x09-\x0D]
WS_RE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# badness scores, all in [0, 1] or small ratios
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "shouting": "n_exclaim / greatest(n_words, 1)",
}
# the cutoff of each rule at each level, from the loosest on
LADDERS = {
    "symbols": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03),
    "dup_lines": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "repeats": (0.5, 0.48, 0.46, 0.43, 0.4, 0.36, 0.32, 0.28, 0.24, 0.2, 0.15, 0.1),
    "capitals": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.4, 0.3),
    "shouting": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.07, 0.05),
}
LEVELS = 12
ALPHA, DELTA = 0.02, 0.05
GOOD_COST = 10          # a lost good document weighs as much as ten bad ones kept


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_exclaim."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*keep, t.alias("_t"), F.array_remove(F.split(t, WS_RE), "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, WS, "")) > 0)
    # 3-word windows as (hash, position), sorted; a window repeats if a neighbour has its hash
    tri = F.expr("""sort_array(transform(
        slice(transform(_w, (w, i) -> struct(xxhash64(w, get(_w, i + 1), get(_w, i + 2)) AS h, i AS i)),
              1, greatest(size(_w) - 2, 0)), x -> x))""")
    d = d.select(*keep, "_t", F.size("_w").cast("long").alias("n_words"), lines.alias("_l"), tri.alias("_g"))
    at = F.expr("""sort_array(transform(
        filter(_g, (x, j) -> x.h = get(_g, j - 1).h OR x.h = get(_g, j + 1).h), x -> x.i))""")
    gone = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    d = d.select(*keep, "n_words",
                 F.length(F.translate("_t", WS, "")).cast("long").alias("word_chars"),
                 gone(SYMBOLS).alias("n_symbols"),
                 F.size("_l").cast("long").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 at.alias("_p"),
                 (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
                 gone("!").alias("n_exclaim"))
    covered = F.expr("""aggregate(_p, named_struct('last', -3, 'n', 0),
        (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last))).n""")
    return d.select(*[c for c in d.columns if c != "_p"], covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, taken back by nine logarithms (about 1e-12 exact)."""
    z = n.cast("double") + 10
    series = ((z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)
              + 1 / (1260 * z * z * z * z * z))
    return series - reduce(lambda a, b: a + b, [F.log(n.cast("double") + i) for i in range(1, 10)])


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact for k < n p (1.0 else: no use above the mean).

    Terms fall from k downwards by a ratio below one; after 5,000 terms the
    rest is bounded by its geometric series, which keeps the bound safe.
    """
    term = F.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
                 + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    odds = F.lit((1 - p) / p)
    steps = F.least(k, F.lit(5000)).cast("int")
    acc = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, j: F.struct((a["t"] * (k - j + 1) * odds / (n - k + j)).alias("t"),
                              (a["s"] + a["t"] * (k - j + 1) * odds / (n - k + j)).alias("s")))
    ratio = (k - steps) * odds / (n - k + steps + 1)
    total = acc["s"] + F.when(k > steps, acc["t"] * ratio / (1 - ratio)).otherwise(0.0)
    return F.when(k < n * F.lit(p), term * total).otherwise(F.lit(1.0))


def rejected_at(level: int) -> Column:
    """Is any score above its cutoff of the level (1 .. ``LEVELS``)?"""
    return reduce(lambda a, b: a | b, [F.expr(e) > F.lit(LADDERS[r][level - 1]) for r, e in RULES.items()])


def risk_table(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "stratum",
               alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum, level, n_good, k_good, n_bad, k_bad, p_value, certified`` for every test."""
    lab = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min("quality").alias("_q"))
    held = counts.filter(~base_failed()).join(lab, id_col)
    held = held.select(stratum, "_q", *[rejected_at(i).alias(f"r_{i}") for i in range(1, LEVELS + 1)])
    hits = [F.count_if((F.col("_q") == q) & F.col(f"r_{i}")).alias(f"{'bg'[q]}_{i}") for i in range(1, LEVELS + 1) for q in (0, 1)]
    agg = held.groupBy(stratum).agg(F.count_if(F.col("_q") == 1).alias("n_good"),
                                    F.count_if(F.col("_q") == 0).alias("n_bad"), *hits)
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"g_{i}").alias("k_good"), F.col(f"b_{i}").alias("k_bad"))
                       for i in range(1, LEVELS + 1)])
    # the number of strata, joined to each of them by a constant key, so that the correction knows it
    m = agg.agg(F.count("*").alias("_s")).withColumn("_one", F.lit(1))
    out = agg.select(stratum, "n_good", "n_bad", F.explode(levels).alias("x")).select(
        stratum, "n_good", "n_bad", "x.*", F.lit(1).alias("_one")).join(F.broadcast(m), "_one").drop("_one")          # one row
    out = out.withColumn("p_value", binomial_tail(F.col("n_good"), F.col("k_good"), alpha))
    # in order: a level counts only if all levels before it are certified as well
    worst = F.max("p_value").over(Window.partitionBy(stratum).orderBy("level"))
    return out.withColumn("certified", worst <= F.lit(delta) / F.col("_s")).drop("_s")


def level_table(risk: DataFrame, stratum: str = "stratum") -> DataFrame:
    """``stratum, level``: the chosen level (null: nothing is rejected)."""
    gain = F.col("k_bad") - GOOD_COST * F.col("k_good")
    ok = F.col("certified") & (gain > 0)
    best = F.max(F.when(ok, F.struct(gain.alias("gain"), (-F.col("level")).alias("loose"))))
    return risk.groupBy(stratum).agg((-best["loose"]).alias("level"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document."""
    ensure_checkpoint_dir(docs.sparkSession)
    src = docs.select(F.col(id_col), F.coalesce(F.col(stratum_col), F.lit("und")).alias("stratum"),
                      F.col(text_col).alias("_text"))
    counts = text_counts(src, [id_col, "stratum"], "_text").checkpoint()
    # one row per language; checkpointed, so its size is known before it is broadcast
    cuts = level_table(risk_table(counts, labels, id_col, "stratum", alpha, delta)).checkpoint()
    cuts = F.broadcast(cuts) if cuts.count() <= 10_000 else cuts
    # not element_at: on a constant array it has a value for a null level
    cutoff = lambda r: F.get(F.array(*[F.lit(c) for c in LADDERS[r]]), F.col("level") - 1)
    passed = reduce(lambda a, b: a & b, [F.coalesce(F.expr(e) <= cutoff(r), F.lit(True)) for r, e in RULES.items()])
    failed = base_failed()
    return counts.join(cuts, "stratum", "left").select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passed).alias("kept"))
