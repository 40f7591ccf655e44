"""Filter sequences over a long response table ``(keys…, rep, resp)``.

A step is a function DataFrame → DataFrame, so sequences compose with ``transform``; several
named ones run over the same responses and label each result with their name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import extraction as X
from evalspark.functions.text import lstrip
from evalspark.registry import FILTERS

Step = Callable[[DataFrame], DataFrame]


def each(fn: Callable[[Column], Column]) -> Step:
    """A step that maps every response on its own."""
    return lambda df: df.withColumn("resp", fn(F.col("resp")))


@FILTERS.add("regex")
def regex(pattern: str = X.NUMBER_ANSWER, group_select: int = 0, fallback: str = X.INVALID) -> Step:
    return each(lambda c: X.regex_answer(c, pattern, group_select, fallback))


@FILTERS.add("regex_pos")
def regex_pos(fallback: list[str] | None = None) -> Step:
    return each(lambda c: X.pos_tags(c, fallback))


@FILTERS.add("remove_whitespace")
def remove_whitespace() -> Step:
    return each(lstrip)


@FILTERS.add("multi_choice_regex")
def multi_choice_regex(choices: str = "choices", **options) -> Step:
    return lambda df: df.withColumn("resp", X.choice_answer(F.col("resp"), F.col(choices), **options))


@FILTERS.add("lowercase")
def lowercase() -> Step:
    return each(F.lower)


@FILTERS.add("uppercase")
def uppercase() -> Step:
    return each(F.upper)


@FILTERS.add("map")
def map_values(mapping: dict[str, str], default: str | None = None) -> Step:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if mapping else F.create_map().cast("map<string,string>")
    return each(lambda c: F.coalesce(F.try_element_at(table, c), F.lit(default)))


@FILTERS.add("format_span")
def format_span() -> Step:
    return each(X.entity_spans)


@FILTERS.add("custom")
def custom(fn: Callable[[DataFrame], Column] | Step) -> Step:
    """A user's own function: frame → frame, or frame → the new response column."""

    def run(df: DataFrame) -> DataFrame:
        out = fn(df)
        return out if isinstance(out, DataFrame) else df.withColumn("resp", out)

    return run


@FILTERS.add("take_first")
def take_first() -> Step:
    return lambda df: df.where(F.col("rep") == 0)


@FILTERS.add("take_first_k")
def take_first_k(keys: list[str], k: int) -> Step:
    """The first k responses of each document; an error where there are fewer."""

    def run(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        enough = F.when(n >= k, F.lit(True)).otherwise(F.raise_error(F.format_string("need %d responses per document, got %d", F.lit(k), n)).cast("boolean"))
        return df.withColumn("_ok", enough).where(F.col("_ok") & (F.col("rep") < k)).drop("_ok")

    return run


@FILTERS.add("majority_vote")
def majority_vote(keys: list[str]) -> Step:
    """The most frequent response of each document, the first seen on ties."""

    def run(df: DataFrame) -> DataFrame:
        votes = df.groupBy(*keys, "resp").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first"))
        best = F.max_by("resp", F.struct(F.col("n"), -F.col("first")))
        return votes.groupBy(*keys).agg(best.alias("resp")).withColumn("rep", F.lit(0).cast("long"))

    return run


def apply_filter_sets(responses: DataFrame, sets: dict[str, list[Step]]) -> DataFrame:
    """Every named sequence of steps over the same responses, in one long table with a ``filter`` column."""
    parts = []
    for name, steps in sets.items():
        out = reduce(lambda df, step: df.transform(step), steps, responses)
        parts.append(out.withColumn("filter", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)
