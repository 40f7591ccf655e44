"""Robustness over prompts, option orders and seeds: consistency and macro accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consistency_rate(df: DataFrame, by: list[str], question: list[str], answer: str) -> DataFrame:
    """Agreeing pairs over all pairs of answers to one question.

    Pairs are counted from answer counts — c(c−1)/2 out of n(n−1)/2 — and never formed.
    """
    counts = df.groupBy(*by, *question, answer).agg(F.count(F.lit(1)).alias("c"))
    per_q = counts.groupBy(*by, *question).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"), F.sum("c").alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return per_q.groupBy(*by).agg(F.when(pairs > 0, F.sum("same") / pairs).otherwise(0.0).alias("consistency_rate"))


def unswapped_answer(answer: Column, label: Column, original: Column) -> Column:
    """Answer under the original option order: either of the two swapped labels is the original one."""
    return F.when((answer == label) | (answer == original), original).otherwise(answer)


def macro_accuracy(df: DataFrame, by: list[str], category: str, correct: Column) -> DataFrame:
    """Mean over categories of the accuracy in each, rounded to four places."""
    per = df.groupBy(*by, category).agg(F.avg(correct.cast("double")).alias("acc"))
    return per.groupBy(*by).agg(F.round(F.avg("acc"), 4).alias("macro_accuracy"))
