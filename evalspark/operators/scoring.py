"""Scores of likelihood responses: multiple choice, rolling, probability mass, minimal pairs, ranks.

Input is one row per (document, choice). Arg-max is ``max_by`` over (score, −index), which combines
on the map side and returns the first maximum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import byte_count, word_count
from evalspark.operators.ordering import running_sum
from evalspark.registry import METRICS


NEVER = float("-inf")


def log_sum(a: Column, b: Column) -> Column:
    """``ln(exp(a) + exp(b))`` from the larger of the two, so that nothing underflows; a null side is left out."""
    top, low = F.greatest(a, b), F.least(a, b)
    return F.when(a.isNull() | b.isNull() | (low == NEVER), top).otherwise(top + F.log1p(F.exp(low - top)))


def per_character(loglik: Column, choice: Column) -> Column:
    """Likelihood by the length of the choice; an empty choice is never the likeliest."""
    return F.when(F.length(choice) == 0, NEVER).otherwise(loglik / F.length(choice))


def first_argmax(score: Column, idx: str = "idx") -> Column:
    return F.max_by(idx, F.struct(score, -F.col(idx)))


@METRICS.add("acc", output="multiple_choice", higher_is_better=True)
def choice_scores(rows: DataFrame, keys: list[str], golds: Column | None = None) -> DataFrame:
    """Per document: predictions and ``acc, acc_norm, acc_mutual_info, exact_match``.

    A gold index beyond the choices scores zero and sets ``gold_defect``. ``golds`` (an array) makes
    any of several answers count.
    """
    many = golds is not None
    gold = golds if many else F.array("gold")
    is_gold = F.array_contains(gold, F.col("idx"))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_choices"),
        F.max(gold).alias("_g"),
        first_argmax(F.col("loglik")).alias("pred"),
        first_argmax(per_character(F.col("loglik"), F.col("choice"))).alias("pred_norm"),
        first_argmax(F.col("loglik") - F.col("uncond")).alias("pred_mi"),
        F.max(F.when(is_gold, F.col("is_greedy").cast("double"))).alias("_greedy"),
    )
    hit = lambda c: F.array_contains("_g", F.col(c)).cast("double")
    return agg.select(
        *keys,
        "n_choices",
        "pred",
        hit("pred").alias("acc"),
        hit("pred_norm").alias("acc_norm"),
        hit("pred_mi").alias("acc_mutual_info"),
        F.coalesce("_greedy", F.lit(0.0)).alias("exact_match"),
        F.exists("_g", lambda g: g >= F.col("n_choices")).alias("gold_defect"),
    )


@METRICS.add("perplexity", output="loglikelihood", higher_is_better=False)
def loglikelihood_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.col("loglik").alias("perplexity"), F.col("is_greedy").cast("double").alias("acc"))


@METRICS.add("word_perplexity", output="loglikelihood_rolling", higher_is_better=False)
def rolling_scores(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Likelihood of a whole text with its words and bytes, the inputs of the weighted perplexities."""
    return rows.select(*keys, "loglik", word_count(F.col(text)).alias("words"), byte_count(F.col(text)).alias("bytes"))


@METRICS.add("brier_score", output="multiple_choice", higher_is_better=False)
def softmax_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each choice with its softmax probability; both windows share one partitioning. NULL if no choice is possible."""
    w = Window.partitionBy(*keys)
    e = rows.withColumn("_e", F.when(F.col("loglik") == NEVER, 0.0).otherwise(F.exp(F.col("loglik") - F.max("loglik").over(w))))
    return e.withColumn("prob", F.try_divide(F.col("_e"), F.sum("_e").over(w))).drop("_e")


def brier_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per document the squared distance of the probabilities from the gold choice."""
    p = softmax_rows(rows, keys)
    miss = F.col("prob") - (F.col("idx") == F.col("gold")).cast("double")
    return p.groupBy(*keys).agg(F.sum(miss * miss).alias("brier"))


@METRICS.add("mc2", output="multiple_choice", higher_is_better=True)
def probability_mass(rows: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """Share of the probability on the options labelled true."""
    p = softmax_rows(rows, keys)
    return p.groupBy(*keys).agg(F.sum(F.when(label, F.col("prob")).otherwise(F.col("prob") * 0)).alias("acc"))


@METRICS.add("likelihood_diff", output="multiple_choice", higher_is_better=False)
def pair_bias(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Two sentences: distance of their likelihoods, and whether the first is the likelier."""
    ll = lambda i: F.max(F.when(F.col("idx") == i, F.col("loglik")))
    p = rows.groupBy(*keys).agg(ll(0).alias("a"), ll(1).alias("b")).where(F.col("b").isNotNull())
    return p.select(*keys, F.abs(F.col("a") - F.col("b")).alias("likelihood_diff"), (F.col("a") > F.col("b")).cast("double").alias("pct_stereotype"))


@METRICS.add("pct_male_preferred", output="multiple_choice", higher_is_better=None)
def gender_bias(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Continuations (female, woman, male, man): log-probability gap and whether a male one is first."""
    ll = lambda i: F.max(F.when(F.col("idx") == i, F.col("loglik")))
    p = rows.groupBy(*keys).agg(*[ll(i).alias(f"l{i}") for i in range(4)], first_argmax(F.col("loglik")).alias("best")).where(F.col("l3").isNotNull())
    female, male = log_sum(F.col("l0"), F.col("l1")), log_sum(F.col("l2"), F.col("l3"))
    return p.select(*keys, (female - male).alias("likelihood_diff"), (F.col("best") > 1).cast("double").alias("pct_male_preferred"))


# Words counted as male and female.
MALE_WORDS = ["male", "man"]
FEMALE_WORDS = ["female", "woman"]


def gender_words(words: Column) -> Column:
    """``struct<difference, male, female, invalid>`` of generated words: which side occurs at all."""
    side = lambda ws: F.exists(words, lambda w: w.isin(*ws)).cast("long")
    m, f = side(MALE_WORDS), side(FEMALE_WORDS)
    return F.struct(
        (m - f).alias("difference_male_female"),
        (m > f).cast("long").alias("pct_male_preferred"),
        ((f == 1) & ~(m > f)).cast("long").alias("pct_female_preferred"),
        ((m + f) == 0).cast("long").alias("pct_invalid"),
    )


@METRICS.add("mrr", output="multiple_choice", higher_is_better=True)
def ranking_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``r1, r2, mrr`` of the gold choice by descending likelihood (its rank is the first equal value)."""
    gold_ll = F.max(F.when(F.col("idx") == F.col("gold"), F.col("loglik"))).over(Window.partitionBy(*keys))
    g = rows.withColumn("_gold_ll", gold_ll).where(F.col("_gold_ll").isNotNull())
    p = g.groupBy(*keys).agg(
        F.count(F.when(F.col("loglik") > F.col("_gold_ll"), 1)).alias("above"),
        (first_argmax(F.col("loglik")) == F.max("gold")).cast("double").alias("r1"),
    )
    return p.select(*keys, "r1", ((F.col("above") == 1).cast("double") + F.col("r1")).alias("r2"), (1.0 / (F.col("above") + 1)).alias("mrr"))


@METRICS.add("logit_yes", output="multiple_choice", higher_is_better=None)
def yes_logit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Logit of yes from the four spellings (yes, Yes, no, No)."""
    ll = lambda i: F.max(F.when(F.col("idx") == i, F.col("loglik")))
    p = rows.groupBy(*keys).agg(*[ll(i).alias(f"l{i}") for i in range(4)])
    yes, no = log_sum(F.col("l0"), F.col("l1")), log_sum(F.col("l2"), F.col("l3"))
    return p.select(*keys, (yes - no).alias("logit_yes")).where(F.col("logit_yes").isNotNull())


def to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metric columns as rows ``(keys…, metric, value)``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.inline(pairs))


def best_true_and_false(scores: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Best score against true and against false references: best, difference, and which is ahead."""
    best = lambda flag: F.max(F.when(F.col("is_true") == F.lit(flag), F.col(metric)))
    p = scores.groupBy(*keys).agg(best(True).alias("t"), best(False).alias("f"))
    return p.select(*keys, F.col("t").alias(f"{metric}_max"), (F.col("t") - F.col("f")).alias(f"{metric}_diff"), (F.col("t") > F.col("f")).cast("double").alias(f"{metric}_acc"))


def union_long(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def abstention_summary(df: DataFrame, by: list[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """Scores in percent where a question may have no answer: rows of (by…, has_answer, answered, exact, f1, na_prob).

    ``exact`` and ``f1`` are scores of the prediction itself; above the ``threshold`` of its no-answer probability a
    row counts as unanswered. ``best_*`` is the highest value over all thresholds: rows are taken in as answered by
    rising probability, rows of equal probability at once, since no threshold can part them. Beginning with all
    unanswerable questions right, an answered row adds its score and an unanswerable one costs its answer. Parts
    without rows are null. Counts per probability are summed over range partitions, so no order is made in one task.
    """
    by, names = by or [], ["exact", "f1"]
    has, p = F.col("has_answer"), F.col("na_prob")
    final = {n: F.when(p > threshold, F.when(has, 0.0).otherwise(1.0)).otherwise(F.col(n).cast("double")) for n in names}
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~has).alias("_none"),
        *[(100 * F.avg(final[n])).alias(n) for n in names],
        *[(100 * F.avg(F.when(has, final[n]))).alias(f"has_ans_{n}") for n in names],
        *[(100 * F.avg(F.when(~has, final[n]))).alias(f"no_ans_{n}") for n in names],
    )
    gain = lambda n: F.when(has, F.col(n).cast("double")).when(F.col("answered"), -1.0).otherwise(0.0)
    steps = df.groupBy(*by, "na_prob").agg(*[F.sum(gain(n)).alias(f"_g_{n}") for n in names])
    for n in names:
        steps = running_sum(steps, [*by, "na_prob"], f"_g_{n}", f"_r_{n}")
    # the sums run over all groups: what was there before a group's first row is taken off
    tops = steps.groupBy(*by).agg(*[(F.max(f"_r_{n}") - F.min_by(F.col(f"_r_{n}") - F.col(f"_g_{n}"), "na_prob")).alias(f"_t_{n}") for n in names])
    keyed = lambda d, *rest: d.select(F.struct(F.lit(0).alias("_"), *by).alias("_key"), *rest)  # noqa: E731  a null group stays a group
    both = totals.withColumn("_key", F.struct(F.lit(0).alias("_"), *by)).join(keyed(tops, *[f"_t_{n}" for n in names]), "_key")
    best = [(100 * (F.col("_none") + F.greatest(F.lit(0.0), F.col(f"_t_{n}"))) / F.col("n")).alias(f"best_{n}") for n in names]
    return both.select(*by, "n", *names, *[f"{k}_ans_{n}" for k in ("has", "no") for n in names], *best)
