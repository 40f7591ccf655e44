"""Benchmark tables made from documents: hidden sentences, frequent words, distractor contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.rows import frequent_word_rows
from evalspark.functions.text import bind, split_words, strip
from evalspark.operators.ordering import top_per_group
from evalspark.operators.prompts import draw_shots
from evalspark.session import settle

# Fixed value: the sentence that is hidden in a text.
NEEDLE = "One of the special magic {type} for {key} is: {value}."


def needle(kind: str, key: Column, value: Column) -> Column:
    out = F.lit(NEEDLE.replace("{type}", kind))
    return F.replace(F.replace(out, F.lit("{key}"), key), F.lit("{value}"), value)


def sentences(text: Column) -> Column:
    """Pieces that end in a sentence mark followed by whitespace."""
    return F.filter(F.split(strip(text), r"(?<=[.!?])\s+", -1), lambda s: s != "")


def hide_sentences(text: Column, needles: Column, depths: Column) -> Column:
    """The text with each needle inserted at its depth (percent of the sentences), in depth order."""

    def build(s: Column) -> Column:
        n = F.size(s)
        spots = F.array_sort(F.transform(depths, lambda d: F.floor(n * d / 100).cast("int")))
        at = lambda i: F.when(i > 0, F.element_at(spots, F.greatest(i, F.lit(1)))).otherwise(0)
        pieces = F.transform(
            needles,
            lambda x, i: F.array(F.array_join(F.slice(s, at(i) + 1, F.greatest(F.element_at(spots, i + 1) - at(i), F.lit(0))), " "), x),
        )
        tail = F.array_join(F.slice(s, at(F.size(needles)) + 1, F.greatest(n - at(F.size(needles)), F.lit(0))), " ")
        return F.array_join(F.concat(F.flatten(pieces), F.array(tail)), " ")

    return bind(sentences(text), build)


def frequent_words(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The k most frequent words of each document (alphabetical on ties) with their counts.

    A document is counted inside its row. Only keys that have several rows have their words shuffled.
    """
    several = settle(docs.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).select(F.col(key).alias("_several")))
    same = F.col(key).eqNullSafe(F.col("_several"))
    own = frequent_word_rows(docs.join(several, same, "left_anti"), key, F.lower(text), k)
    words = docs.join(several, same, "left_semi").select(key, F.explode(split_words(F.lower(text))).alias("word"))
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(top_per_group(counts, [key], [F.col("n").desc(), F.col("word")], k, "rank"))


def numbered_words(text: Column) -> Column:
    """``1. word 2. word …``"""
    return F.array_join(F.transform(split_words(F.lower(text)), lambda w, i: F.concat((i + 1).cast("string"), F.lit(". "), w)), " ")


def distractor_contexts(questions: DataFrame, pool: DataFrame, key: str, group: list[str], size: str, n_docs: int, budget: int, seed: int) -> DataFrame:
    """``key, docs``: pseudo-random other documents in drawn order while their summed size fits."""
    drawn = draw_shots(questions, pool, key, group, n_docs, seed, [size])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x[size].cast("long"))
    fits = F.filter(
        F.transform("shots", lambda s, i: F.struct(s["id"].alias("id"), total(F.slice(F.col("shots"), F.lit(1), i + 1)).alias("running"))),
        lambda x: x["running"] <= budget,
    )
    return drawn.select(key, fits.alias("docs"))
