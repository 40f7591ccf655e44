"""Instruction following: rules × responses, strict and loose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.constraints import follows, loose_variants
from evalspark.functions.text import bind


def check_rules(df: DataFrame, keys: list[str], response: str, rules: str) -> DataFrame:
    """``(keys…, rule, strict, loose)`` of responses with their own ``array<struct<rule, args>>``.

    Rules and response variants meet inside the row, so a text is neither copied nor shuffled; loose counts if any
    variant follows the rule, and variants are looked at only where the response itself does not and only up to the first
    that does.
    """

    def verdict(vs: Column, r: Column) -> Column:
        follow = lambda v: follows(v, r["rule"], r["args"])
        others = F.exists(F.slice(vs, F.lit(2), F.size(vs)), follow)
        loose = lambda strict: F.when(strict | strict.isNull(), strict).otherwise(others)
        return bind(follow(F.get(vs, F.lit(0))), lambda s: F.struct(r["rule"].alias("rule"), s.alias("strict"), loose(s).alias("loose")))

    verdicts = bind(loose_variants(F.col(response)), lambda vs: F.transform(F.col(rules), lambda r: verdict(vs, r)))
    return df.select(*keys, F.inline(verdicts))


def rule_accuracy(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Prompt-level (all rules of a response) and instruction-level accuracy, strict and loose."""
    x = lambda c: F.col(c).cast("double")
    per = checked.where(F.col("strict").isNotNull()).groupBy(*keys).agg(
        F.min(x("strict")).alias("ps"), F.min(x("loose")).alias("pl"), F.sum(x("strict")).alias("is"), F.sum(x("loose")).alias("il"), F.count(F.lit(1)).alias("k")
    )
    return per.agg(
        F.avg("ps").alias("prompt_level_strict_acc"),
        (F.sum("is") / F.sum("k")).alias("inst_level_strict_acc"),
        F.avg("pl").alias("prompt_level_loose_acc"),
        (F.sum("il") / F.sum("k")).alias("inst_level_loose_acc"),
    )
