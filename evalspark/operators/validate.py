"""Consistency checks between frozen inputs, raw records, scored samples and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def id_differences(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, in one aggregation instead of two anti-joins."""
    side = lambda df, s: df.select(F.col(key), F.lit(s).alias("s"))
    both = side(expected, 1).unionByName(side(seen, 2)).groupBy(key).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return both.where(F.col("lo") == F.col("hi")).select(key, F.when(F.col("lo") == 1, "missing").otherwise("unexpected").alias("defect"))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def likelihood_defects(df: DataFrame, keys: list[str]) -> DataFrame:
    """Option likelihoods that are not the finite sum of as many token log-probabilities as tokens."""
    probs = F.col("continuation_token_logprobs")
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    defect = (
        F.when(~is_finite(F.col("total_loglikelihood")), "total not finite")
        .when(F.size(probs) != F.size("continuation_token_ids"), "token counts differ")
        .when(F.exists(probs, lambda x: ~is_finite(x)), "token not finite")
        .when(F.abs(total - F.col("total_loglikelihood")) > TOLERANCE * F.greatest(F.lit(1.0), F.abs(total)), "sum differs")
    )
    return df.select(*keys, defect.alias("defect")).where(F.col("defect").isNotNull())


def generation_defects(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raw generations whose token count is off or whose end is not recorded."""
    defect = F.when(F.size("token_ids") != F.col("generated_tokens"), "token count").when(F.col("finish_reason").isNull(), "no finish reason")
    return df.select(*keys, defect.alias("defect")).where(F.col("defect").isNotNull())


def response_mismatches(scored: DataFrame, raw: DataFrame, key: str, response: str) -> DataFrame:
    """Ids whose scored response is not the raw one (compared by SHA-256)."""
    a = scored.select(key, F.sha2(response, 256).alias("scored_hash"))
    b = raw.select(key, F.sha2(response, 256).alias("raw_hash"))
    return a.join(b, key).where(F.col("scored_hash") != F.col("raw_hash")).select(key)


def recomputed_mismatches(df: DataFrame, key: str, stored: str, again: Column, score: str, rescored: Column) -> DataFrame:
    """Rows whose stored extraction or score differs from what the stored response gives."""
    out = df.select(key, F.col(stored).alias("stored"), again.alias("again"), F.col(score).alias("score"), rescored.alias("rescored"))
    defect = F.when(~F.col("stored").eqNullSafe(F.col("again")), "extraction").when(F.abs(F.col("score") - F.col("rescored")) > TOLERANCE, "score")
    return out.withColumn("defect", defect).where(F.col("defect").isNotNull()).select(key, "defect")


def aggregate_mismatches(results: DataFrame, samples: DataFrame, by: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Reported aggregates that are not the mean of their samples or miss some of them."""
    again = samples.groupBy(*by).agg(F.avg("value").alias("again"), F.count(F.lit(1)).alias("n_seen"))
    j = results.join(again, by, "full_outer")
    defect = (
        F.when(F.col("n_seen").isNull(), "no samples")
        .when(F.col("value").isNull(), "not reported")
        .when(F.col("n") != F.col("n_seen"), "count")
        .when(F.abs(F.col("value") - F.col("again")) > tolerance, "value")
    )
    return j.withColumn("defect", defect).where(F.col("defect").isNotNull()).select(*by, "defect")
