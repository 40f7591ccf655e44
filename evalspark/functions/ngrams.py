"""Word n-grams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import bind


def windows(tokens: Column, n: int) -> Column:
    """Array of token windows of length ``n``; empty when there are fewer tokens.

    The guard sits inside the expression: generator inputs may be evaluated on rows that an
    earlier filter was meant to drop.
    """
    starts = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return bind(tokens, lambda t: F.transform(starts(t), lambda i: F.slice(t, i, n)))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """Array of joined n-grams."""
    starts = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return bind(tokens, lambda t: F.transform(starts(t), lambda i: F.array_join(F.slice(t, i, n), sep)))


def ngram_hashes(tokens: Column, n: int) -> Column:
    """Array of 64-bit hashes of the n-grams: each word is hashed once, and an n-gram is the hash of its word hashes."""
    starts = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return bind(F.transform(tokens, lambda w: F.xxhash64(w)), lambda t: F.transform(starts(t), lambda i: F.xxhash64(F.slice(t, i, n))))


def ngram_hash(ngram: Column) -> Column:
    """The same hash of one joined n-gram."""
    return F.xxhash64(F.transform(F.split(ngram, " ", -1), lambda w: F.xxhash64(w)))


def anchored_runs(tokens: Column, n: int) -> Column:
    """Array of ``(anchor, start, length, words)``: the n-grams of a text as runs of ``length`` neighbours.

    The anchor of an n-gram is the least hash of the groups of a few words inside it, so equal n-grams have equal anchors,
    and neighbours mostly share theirs. ``words`` holds the n-grams from ``start`` (from 1) on, joined by blanks: each
    word travels about three times for n of 13, and not 13 times.
    """
    m = (n + 2) // 4 or 1

    def cut(t: Column, a: Column, breaks: Column) -> Column:
        def run(s: Column, j: Column) -> Column:
            length = F.coalesce(F.get(breaks, j + 1), F.size(a) + 1) - s
            words = lambda k: F.array_join(F.slice(t, s, k + (n - 1)), " ")
            return F.struct(F.get(a, s - 1).alias("anchor"), s.alias("start"), length.alias("length"), words(length).alias("words"))

        return F.transform(breaks, run)

    def split(t: Column, a: Column) -> Column:
        marks = F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1) != x), i + 1))
        return bind(F.filter(marks, lambda i: i.isNotNull()), lambda b: cut(t, a, b))

    def anchors(t: Column, groups: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_min(F.slice(groups, i, n - m + 1)))

    return bind(tokens, lambda t: bind(ngram_hashes(t, m), lambda g: bind(anchors(t, g), lambda a: split(t, a))))
