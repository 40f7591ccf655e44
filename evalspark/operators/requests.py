"""Request tables: fan-out per choice, unconditional and mixed requests, repeats, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import WHITESPACE
from evalspark.operators.ordering import with_position


def choice_requests(df: DataFrame, keys: list[str], context: str, choices: str, delimiter: str = " ",
                    multiple_input: bool = False, target: str | None = None, mutual_information: bool = False) -> DataFrame:
    """One likelihood request per choice.

    With ``multiple_input`` the choice goes into the context and the target is the continuation.
    ``mutual_information`` appends an unconditional request per choice with index ``n + i``.
    """
    rows = df.select(*keys, context, *([target] if target else []), F.size(choices).alias("_n"), F.posexplode(choices).alias("idx", "_c"))
    if multiple_input:
        ctx, cont = F.concat(F.col(context), F.col("_c")), F.concat(F.lit(delimiter), F.col(target))
    else:
        ctx, cont = F.col(context), F.concat(F.lit(delimiter), F.col("_c"))
    asked = F.array(F.struct(F.col("idx").alias("idx"), ctx.alias("context"), cont.alias("continuation")))
    if mutual_information:
        alone = F.struct((F.col("idx") + F.col("_n")).alias("idx"), F.lit("").alias("context"), F.concat(F.lit(delimiter), F.col("_c")).alias("continuation"))
        asked = F.concat(asked, F.array(alone))
    return rows.select(*keys, F.lit("loglikelihood").alias("request_type"), F.inline(asked))


def answer_or_abstain_requests(df: DataFrame, keys: list[str], context: str, until: str = "\n", abstain: str = " unanswerable") -> DataFrame:
    """Two requests per row: generate an answer, and the likelihood of abstaining."""
    both = F.array(
        F.struct(F.lit("generate_until").alias("request_type"), F.to_json(F.struct(F.array(F.lit(until)).alias("until"))).alias("argument")),
        F.struct(F.lit("loglikelihood").alias("request_type"), F.lit(abstain).alias("argument")),
    )
    return df.select(*keys, context, F.inline(both))


def repeat_requests(df: DataFrame, repeats: int) -> DataFrame:
    """Each request ``repeats`` times with its repetition number."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def request_hash(kind: Column, *args: Column) -> Column:
    """SHA-256 of the request as a JSON list."""
    return F.sha2(F.to_json(F.array(kind, *args)), 256)


def shift_trailing_space(context: Column, continuation: Column) -> tuple[Column, Column]:
    """Trailing blanks of the context moved to the front of the continuation."""
    tail = F.regexp_extract(context, rf"({WHITESPACE}*)$", 1)
    return F.regexp_replace(context, rf"{WHITESPACE}+$", ""), F.concat(tail, continuation)


def ordered_digest(df: DataFrame, order: list[str], digest: str, group: list[str] | None = None, fanout: int = 4096) -> DataFrame:
    """SHA-256 of the row digests in order, per group, by one rule for groups of every size.

    Rows are numbered in order from 0. Three times over, the digests of each block of ``fanout`` numbers are joined
    and hashed, and the block's number takes their place. A group's digest depends on its own rows alone, and no task
    holds more than a block; a group of more than ``fanout`` cubed rows has a larger last block.
    """
    keys = group or []
    level = with_position(df.select(*keys, *order, F.col(digest).alias("_h")), order, group).select(*keys, "pos", "_h")
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_h"))), lambda s: s["_h"]), ""), 256)
    for last in (False, False, True):
        block = F.lit(0).cast("long") if last else F.floor(F.col("pos") / fanout)
        level = level.groupBy(*keys, block.alias("pos")).agg(joined.alias("_h"))
    return level.select(*keys, F.col("_h").alias("digest"))
