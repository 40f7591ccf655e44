"""Row numbers, limits and shards in an explicit order, without pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import broadcast_if_small, ensure_checkpoint_dir


def with_position(df: DataFrame, order: list[str | Column], group: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (over all rows, or inside each group).

    Rows are range-partitioned and sorted, so a hot group is split over many tasks; the partition
    sizes (one row per partition) give the offsets. The sorted rows are checkpointed because range
    bounds are sampled and a recomputation could place them elsewhere. ``order`` must be unique.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(g) for g in group or []] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    placed = placed.checkpoint()
    part, row = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + row)
        .drop("_part", "_off", "_mid")
    )
    if not group:
        return out
    first = out.groupBy(*group).agg(F.min(name).alias("_first"))
    return out.join(broadcast_if_small(first), group).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def first_rows_of(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows in a unique order: the k-th key is found on the keys alone and becomes a
    filter, so whole rows are neither sorted nor moved."""
    last = with_position(df.select(*order), order).where(F.col("pos") == k - 1).first() if k > 0 else None
    if last is None:
        return df.limit(0) if k <= 0 else df
    if len(order) == 1:
        return df.where(F.col(order[0]) <= F.lit(last[0]))
    return df.where(F.struct(*order) <= F.struct(*[F.lit(last[c]).alias(c) for c in order]))


def head_fraction(df: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """The first ``int(fraction * n)`` rows in source order."""
    return first_rows_of(df, order, int(fraction * df.count()))


def sample_size(n: int, limit: float | None) -> int | None:
    """Absolute number of rows of a limit; a limit below one is a share, rounded up."""
    if limit is None:
        return None
    return -int(-(n * limit) // 1) if limit < 1.0 else int(limit)


def limit_rows(df: DataFrame, order: list[str], limit: float) -> DataFrame:
    """At most ``limit`` rows in source order; a share of the rows when below one."""
    k = sample_size(df.count() if limit < 1 else 0, limit)
    return first_rows_of(df, order, k)


def limit_to_ids(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The rows named by an explicit id list."""
    return df.join(broadcast_if_small(ids.select(*on).distinct()), on, "left_semi")


def shard(df: DataFrame, order: list[str], rank: int, world: int) -> DataFrame:
    """Every ``world``-th row from ``rank`` on."""
    return with_position(df, order).where(F.pmod("pos", F.lit(world)) == rank)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group; each task keeps only its own first ``k`` before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def running_sum(df: DataFrame, order: list[str], value: str, name: str = "running") -> DataFrame:
    """Inclusive running sum of ``value`` in a unique ``order`` over all rows.

    Range partitions are summed on their own; the totals of earlier partitions are added as offsets.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("_part", F.shiftright("_mid", 33))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_t"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.sum(value).over(inside)).drop("_part", "_mid", "_off")
    )
