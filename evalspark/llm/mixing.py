"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import WORD, cut_lineage
from evalspark.operators.ordering import with_position
from evalspark.session import broadcast_if_small

SIZE, COPIES = "__mix_size", "__mix_copies"


def words_in(text: str | Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(seed: str, *columns: str) -> Column:
    """Uniform number in [0, 1) from the seed and the columns alone, the same in every run and engine."""
    parts = [F.lit(seed)] + [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) for rows of (source, size).

    Sources, by code point with null last, take ``weights`` in turn and share all words by weight. A target stops at
    ``most`` times the words of its source; what is over is shared again among the others until none is above. A
    source without words gets target 0. Only three sums per round of sharing reach the driver.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = cut_lineage(with_position(own, [F.col("source").asc_nulls_last()], name="place"))
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    total, heavy = own.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, over = total, heavy

    def full() -> Column:
        wide = "decimal(19,0)"
        return cap.cast(wide) * F.lit(over).cast(wide) <= F.col("weight").cast(wide) * F.lit(left).cast(wide)

    while over:
        taken, light = own.where(full()).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - taken, heavy - light) == (left, over):
            break
        left, over = total - taken, heavy - light
    share = (F.col("weight").cast("long") * F.lit(left)).cast("double") / F.lit(float(max(over, 1)))
    target = F.when(F.lit(over == 0) | full(), cap.cast("double")).otherwise(share)
    return own.select("source", "source_size", target.alias("target"))


def with_copies(df: DataFrame, text: str = "text", source: str = "source", key: tuple[str, ...] = ("doc_id",), seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``df`` with the words of each row, its source's size and target, and the number of copies that the mix takes.

    Copies: the whole part of target / source size, plus one if the row's own draw is below the fraction. Rows that
    agree in ``key`` draw alike. Rows without words get the copies of their source's rate as well. Texts stay where
    they are: sources are few beside rows and are broadcast when small; else the join splits hot sources.
    Result columns: those of ``df`` and __mix_size, __mix_source_size, __mix_target, __mix_copies.
    """
    sized = df.withColumn(SIZE, words_in(F.col(text)))
    goals = source_targets(sized.select(F.col(source).alias("source"), F.col(SIZE).alias("size")), weights, most)
    goals = goals.select(F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"))
    out = sized.join(broadcast_if_small(goals), F.col(source).eqNullSafe(F.col("__mix_source")), "left").drop("__mix_source")
    rate = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = draw(seed, *key) < rate - whole
    return out.withColumn(COPIES, (whole + extra.cast("long")).cast("long"))


def mixed(df: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it has copies, with the columns of ``df``."""
    out = with_copies(df, **how)
    repeated = out.where(F.col(COPIES) > 0).withColumn("__mix_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(COPIES))))
    return repeated.select(*[F.col(f"`{c}`") for c in df.columns])
