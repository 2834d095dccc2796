"""Quality rules with thresholds of controlled risk.

Base measures are counted per text with array functions, without a shuffle.
On top of fixed base limits, every rule (a measure and a row of cutoffs from
lenient to strict) gets a cutoff per stratum from labelled holdout documents: a
cutoff is certified if the exact binomial probability of seeing so few good
holdout documents rejected, were the true false-rejection rate ``alpha`` or
more, is at most ``delta`` shared out over all strata and rules (Bonferroni;
along one rule's cutoffs the tests go in a fixed order from lenient to strict,
which needs no further share). Each rule gets an equal part of ``alpha``, so all
rules together falsely reject at most ``alpha`` of a stratum's good documents
with probability ``1 - delta`` in all strata at once. Among certified cutoffs
the one that tells bad from good best is used, and none if it catches too few
bad ones to be worth it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import stored

#: The measures of the rules and their cutoffs, from lenient to strict; a document above a cutoff is rejected.
RULES = (
    ("symbol_share", (0.5, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02)),
    ("dup_line_rate", (0.2, 0.1, 0.05, 0.02, 0.01, 0.005)),
    ("repeat_share", (0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    ("word_length", (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    ("word_shortness", (0.6, 0.5, 0.4, 0.35, 0.3, 0.25)),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = None) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text has no words, like an empty one; such documents fail. Windows
    of five words are told apart by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blanks = " \t\n\x0b\x0c\r"
    n_of = lambda c: F.char_length(c).cast("long")
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    d = docs.select(
        F.col(id_col).alias("doc_id"), stratum.alias("stratum"),
        n_of(F.translate(text, blanks, "")).alias("word_chars"),
        (n_of(text) - n_of(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, blanks, "") != "").alias("lines"),
        F.transform(F.array_remove(F.split(F.translate(text, blanks, " " * len(blanks)), " "), ""), lambda w: F.xxhash64(w)).alias("words"),
    )
    d = d.select("*", F.size("words").alias("n"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines")).drop("lines")
    at = lambda i, k: F.get(F.col("words"), i + k)
    grams = F.when(F.col("n") >= 5, F.transform(F.sequence(F.lit(0), F.col("n") - 5), lambda i: F.xxhash64(*(at(i, k) for k in range(5)))))
    d = d.withColumn("grams", F.coalesce(grams, F.expr("cast(array() as array<bigint>)"))).drop("words")
    ordered = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    # texts without a repeated window, nearly all, skip the sort
    d = d.withColumn("ordered", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), ordered)).drop("grams")
    same = lambda e, k: F.get(F.col("ordered"), k)["g"] == e["g"]
    twice = F.filter("ordered", lambda e, k: F.coalesce(same(e, k - 1), F.lit(False)) | F.coalesce(same(e, k + 1), F.lit(False)))
    d = d.withColumn("starts", F.array_sort(F.transform(twice, lambda e: e["i"]))).drop("ordered")
    # each window covers five words, or only up to the next one's start
    covered = F.transform("starts", lambda s, k: F.coalesce(F.least(F.lit(5), F.get(F.col("starts"), k + 1) - s), F.lit(5)))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0))
    d = d.select("doc_id", "stratum", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("n_dup_lines").cast("long").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    # stored, as a filter on the result would be pushed below the arrays and count them anew at every use
    return stored(d, "measures")


def rule_measures() -> dict[str, Column]:
    """The measures that RULES name; null where there are no words."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return {
        "symbol_share": per("n_symbols", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_words"), "repeat_share": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"), "word_shortness": per("n_words", "word_chars"),
    }


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X binomial(n, p): the exact sum, term by term, in logarithms."""
    odds = math.log(p) - math.log1p(-p)
    first = n.cast("double") * math.log1p(-p)

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1).cast("double") / j) + odds
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    js = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(js, F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"])


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, worth: float = 5.0, rules=RULES, id_col: str = "doc_id", good_col: str = "quality") -> DataFrame:
    """stratum, rule, cutoff, n_good, n_false: the cutoffs in force.

    ``labels`` has 1 for good and 0 for bad documents; null labels and labels of
    unknown documents teach nothing, and a document with several labels is good
    if one says so. Documents that fail the base limits take no part. A cutoff
    must reject ``worth`` times as large a share of the bad as of the good.
    """
    known = labels.where(F.col(good_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(good_col).alias("good"))
    held = measured.where(~F.col("base_failed")).join(known, "doc_id")
    of = rule_measures()
    tests = F.array(*(F.struct(F.lit(name).alias("rule"), of[name].alias("x"), F.lit(k).alias("rank"), F.lit(float(c)).alias("cutoff")) for name, cutoffs in rules for k, c in enumerate(cutoffs)))
    good, out = F.col("good") == 1, F.coalesce(F.col("t.x") > F.col("t.cutoff"), F.lit(False))
    counts = held.select("stratum", "good", F.explode(tests).alias("t")).groupBy("stratum", "t.rule", "t.rank", "t.cutoff").agg(
        F.count_if(good).alias("n_good"), F.count_if(good & out).alias("n_false"), F.count_if(~good).alias("n_bad"), F.count_if(~good & out).alias("n_caught"))
    counts = stored(counts, "holdout-counts")  # strata * rules * cutoffs rows
    strata = max(1, counts.select("stratum").distinct().count())
    level, share = math.log(delta / (strata * len(rules))), alpha / len(rules)
    p = F.when(F.col("n_false") < F.col("n_good") * share, log_binomial_cdf(F.col("n_false"), F.col("n_good"), share)).otherwise(F.lit(0.0))
    up_to = Window.partitionBy("stratum", "rule").orderBy("rank")
    good_share, bad_share = F.col("n_false") / F.greatest("n_good", F.lit(1)), F.col("n_caught") / F.greatest("n_bad", F.lit(1))
    sure = counts.withColumn("log_p", p).withColumn("sure", F.max("log_p").over(up_to) <= level).withColumn("gain", bad_share - worth * good_share)
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "rank")
    return sure.where(F.col("sure") & (F.col("gain") > 0)).withColumn("k", F.row_number().over(best)).where("k = 1").select("stratum", "rule", "cutoff", "n_good", "n_false")


def apply_rules(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add kept: false if the base limits or a rule's cutoff of the stratum reject."""
    limits = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))  # at most one entry per rule
    over = F.lit(False)
    for name, x in rule_measures().items():
        over = over | F.coalesce(x > F.col("limits")[name], F.lit(False))
    return measured.join(limits, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over).drop("limits")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", **risk) -> DataFrame:
    """The measures of every document and whether it is kept.

    Strata are the values of ``stratum_col``, null being one of them. Without
    labels only the base limits count. Repeated rows and null ids are judged as
    any other; an empty table gives no rows; other columns are left out.
    """
    measured = measures(docs, id_col, text_col, stratum_col)
    return apply_rules(measured, certified_cutoffs(measured, labels, **risk))
