"""Registered queries: a Spark callable and, where SQL can state it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from evalspark.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy readers over one data directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def corpus(self) -> DataFrame:
        """``documents`` spread over the cluster by ``doc_id``."""
        return spread(self.documents, "doc_id")


def query(name: str, sql: str | None = None):
    """Register ``fn(Tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


# --- SQL fragments shared by the oracle statements -------------------------------------------------

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"  # quoted for SQL


def sql_tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}+'), lambda w: w <> '')"


def sql_clean(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{PUNCT}', 'abcdefghijklmnopqrstuvwxyz')"


def sql_ngrams(tokens: str, n: int) -> str:
    """List of space-joined n-grams of a token list expression."""
    return (
        f"list_transform(range(greatest(len({tokens}) - {n} + 1, 0)), "
        f"lambda i: array_to_string(list_slice({tokens}, i + 1, i + {n}), ' '))"
    )
