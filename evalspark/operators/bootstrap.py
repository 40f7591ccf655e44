"""Bootstrap standard errors.

Rows with the same contributions are one class with a count c, and a class has one Poisson(c) weight per replicate:
the sum of c Poisson(1) weights, drawn at once. So work is distinct values times replicates, replicates need no
gathering of a task's rows, and only partial sums per replicate are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.draws import PRIME, draw
from evalspark.functions.text import bind
from evalspark.operators.ordering import with_position
from evalspark.session import broadcast_if_small, ensure_checkpoint_dir, settle

#: Rows of a class that share a draw; a larger class is dealt into parts of so many, whose weights add up.
PART = 1 << 16
#: Replicates whose weights one row computes.
BLOCK = 1000
_BUCKET = 21  # a draw has 31 bits; its first 10 find the place in the table


def _low(c: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(c - 8 * F.sqrt(c)) - 8).cast("long")


def poisson_table(counts: DataFrame, c: str = "_c") -> DataFrame:
    """``(c, _at, _low, _bounds)``: the inverse of the Poisson distribution of each mean ``c``, in 1024 parts of the
    range of a draw: the weight at the part's beginning and the draws in it from which each further weight holds.

    Terms are summed from eight deviations below the mean to ten above and divided by their total, so that nothing
    underflows at any mean.
    """
    mean = F.col(c).cast("double")

    def step(acc: Column, k: Column) -> Column:
        q = acc["q"] * mean / k.cast("double")
        return F.struct(q.alias("q"), (acc["cum"] + q).alias("cum"), F.concat(acc["all"], F.array(acc["cum"] + q)).alias("all"))

    one, low = F.lit(1.0), _low(F.col(c))
    last = F.ceil(F.col(c) + 10 * F.sqrt(c)).cast("long") + 20
    terms = F.aggregate(F.sequence(low + 1, last), F.struct(one.alias("q"), one.alias("cum"), F.array(one).alias("all")), step)
    bounds = bind(terms, lambda t: F.transform(t["all"], lambda x: F.floor(x / t["cum"] * PRIME).cast("long")))
    made = counts.select(c).distinct().repartition(c).select(c, low.alias("_least"), bounds.alias("_all"))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << (31 - _BUCKET)) - 1).cast("long")))
    none = made.select(c, "_least", places.alias("_at"), F.lit(None).cast("long").alias("_b"))
    some = made.select(c, "_least", F.explode("_all").alias("_b")).select(c, "_least", F.shiftright("_b", _BUCKET).alias("_at"), "_b")
    parts = none.unionByName(some).groupBy(c, "_least", "_at").agg(F.sort_array(F.collect_list("_b")).alias("_bounds"))
    before = Window.partitionBy(c).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(c, "_at", (F.col("_least") + F.coalesce(F.sum(F.size("_bounds")).over(before), F.lit(0))).alias("_low"), "_bounds")


def replicates(classes: DataFrame, key: str, count: str, iters: int, seed: int) -> DataFrame:
    """Rows with a ``count`` to ``(…, replicate, w)`` with the Poisson(count) weight of each replicate.

    A weight table is made once for each distinct count. Replicates are dealt in blocks over all tasks, so that a
    single class is many tasks' work.
    """
    parts = classes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / PART).cast("long"))))
    parts = parts.withColumn("_c", F.least(F.lit(PART).cast("long"), F.col(count) - F.col("_part") * PART)).withColumn("_base", draw(seed, F.col(key), F.col("_part")))
    ensure_checkpoint_dir(classes.sparkSession)
    parts = parts.checkpoint()
    blocks = parts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((iters - 1) // BLOCK)))).repartition(key, "_part", "_block")
    first = F.col("_block") * BLOCK
    rows = blocks.withColumn("replicate", F.explode(F.sequence(first, F.least(first + BLOCK, F.lit(iters)) - 1)))
    # the last step of draw(seed, key, part, replicate), on plain columns
    rows = rows.withColumn("_v", (F.col("_base") * 48271 + F.col("replicate") * F.lit(69621).cast("long") + 11) % PRIME)
    rows = rows.withColumn("_u", (F.col("_v") * F.col("_v") + F.col("_v") * 16807 + 7) % PRIME).withColumn("_at", F.shiftright("_u", _BUCKET))
    found = rows.join(settle(poisson_table(parts)), ["_c", "_at"])
    w = F.col("_low") + F.when(F.size("_bounds") == 0, 0).otherwise(F.size(F.filter("_bounds", lambda b: F.col("_u") >= b)))
    return found.select(*classes.columns, "replicate", w.alias("w")).where("w > 0")


def bootstrap_stderr(
    samples: DataFrame,
    by: list[str],
    key: str,
    contributions: dict[str, Column],
    statistic: Callable[[dict[str, Column]], Column],
    iters: int = 100_000,
    seed: int = 0,
) -> DataFrame:
    """``(by…, stderr)``: standard deviation over replicates of a statistic of weighted sums.

    ``contributions`` are per-row terms; ``statistic`` receives their weighted sums by name and the summed weight as
    ``w``; a replicate for which it is null (no positive, say) is left out. A class of rows with equal contributions
    draws from its least ``key``. Work is distinct contributions times ``iters``: for a metric of a corpus, such as
    BLEU, whose rows all differ, 100 replicates are usual.
    """
    rows = samples.select(*by, F.col(key).alias("_key"), *[c.alias(n) for n, c in contributions.items()])
    classes = rows.groupBy(*by, *contributions).agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_key"))
    sums = replicates(classes, "_key", "_n", iters, seed).groupBy(*by, "replicate").agg(F.sum("w").alias("w"), *[F.sum(F.col(n) * F.col("w")).alias(n) for n in contributions])
    per = sums.select(*by, statistic({n: F.col(n) for n in [*contributions, "w"]}).alias("s"))
    return per.groupBy(*by).agg(F.stddev_samp("s").alias("stderr"))


def bootstrap_positional_median(samples: DataFrame, by: list[str], order: list[str], value: str, iters: int, seed: int) -> DataFrame:
    """The unsorted "median" of a resample is one uniformly drawn row; draw it by position."""
    placed = with_position(samples.select(*by, *order, value), order, by)
    n = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(order[0]).alias("_k"))
    drawn = n.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(iters - 1)))).withColumn(
        "pos", draw(seed, F.col("_k"), F.col("replicate")) % F.col("_n")
    )
    return broadcast_if_small(drawn).join(placed, [*by, "pos"]).groupBy(*by).agg(F.stddev_samp(value).alias("stderr"))
