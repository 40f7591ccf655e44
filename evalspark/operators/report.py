"""Telemetry summaries, previews, result tables and catalogues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import fixed
from evalspark.operators.groups import descendants

# Finish reasons that mean the length limit was hit.
CAPPED = ["length", "max_tokens", "max_length"]


def first_per_request(log: DataFrame, order: str) -> DataFrame:
    """One record per request hash, the first in log order (combined on the map side)."""
    fields = [c for c in log.columns if c != "request_hash"]
    return (
        log.where(F.coalesce("request_hash", F.lit("")) != "")
        .groupBy("request_hash")
        .agg(F.min_by(F.struct(*fields), order).alias("r"), F.count(F.lit(1)).alias("n_records"))
        .select("request_hash", "n_records", "r.*")
    )


def telemetry(log: DataFrame, by: list[str], order: str, capped_reasons: list[str] | None = None) -> DataFrame:
    """Unique, duplicate and unidentified records, capped ones, token totals, finish reasons as a map."""
    unique = first_per_request(log, order)
    tokens = F.when(F.col("generated_tokens") >= 0, F.col("generated_tokens").cast("long"))
    known = F.col("finish_reason").isNotNull()
    main = unique.groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_requests"),
        F.sum(F.col("n_records") - 1).alias("duplicates"),
        F.count(F.when(known, 1)).alias("finish_known"),
        F.count(F.when(F.lower("finish_reason").isin(capped_reasons or CAPPED), 1)).alias("capped"),
        F.count(tokens).alias("token_known"),
        F.sum(tokens).alias("token_total"),
        F.max(tokens).alias("token_max"),
    )
    reasons = (
        unique.groupBy(*by, F.coalesce("finish_reason", F.lit("unknown")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*by)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "c")))).alias("finish_reasons"))
    )
    missing = log.groupBy(*by).agg(F.count(F.when(F.coalesce("request_hash", F.lit("")) == "", 1)).alias("missing_hash"))
    return missing.join(main, by, "left").join(reasons, by, "left")


def likelihood_telemetry(log: DataFrame, by: list[str]) -> DataFrame:
    """Option requests apart from the questions they belong to."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("option_requests"), F.count_distinct("uid").alias("questions"), F.sum("n_tokens").alias("likelihood_tokens")
    )


def sample_summary(samples: DataFrame, subject: str, invalid: str = "[invalid]") -> DataFrame:
    """Counts per subject and over all (subject NULL): unique, correct, invalid, disagreeing."""
    right, known = F.col("metric") == 1, F.col("metric").isin(0, 1)
    c = lambda cond: F.count(F.when(cond, 1))
    return samples.groupingSets([[subject], []], subject).agg(
        F.count(F.lit(1)).alias("n"),
        c(known).alias("scored"),
        c(right).alias("correct"),
        c(F.col("prediction") == invalid).alias("invalid"),
        c(known & (right != (F.col("prediction") == F.col("target")))).alias("disagreement"),
    )


def balanced_preview(samples: DataFrame, bucket: Column, names: list[str], order: str, limit: int = 50) -> DataFrame:
    """At most ``limit`` rows taken in turn from the buckets in the order of ``names``."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("bucket"))
    return (
        samples.withColumn("bucket", bucket)
        .withColumn("turn", F.row_number().over(Window.partitionBy("bucket").orderBy(order)))
        .where(F.col("turn") <= limit)
        .withColumn("_b", rank)
        .orderBy("turn", "_b")
        .limit(limit)
        .drop("_b")
    )


# Arrows of the results table.
ARROWS = {True: "↑", False: "↓"}


def results_table(results: DataFrame) -> DataFrame:
    """Printable rows: task, version, filter, shots, metric, arrow, value, ±, standard error."""
    arrow = F.when(F.col("higher_is_better"), ARROWS[True]).when(~F.col("higher_is_better"), ARROWS[False]).otherwise("")
    return results.select(
        "task",
        F.coalesce("version", F.lit("    N/A")).alias("version"),
        "filter",
        F.coalesce(F.col("shots").cast("string"), F.lit(" ")).alias("shots"),
        "metric",
        arrow.alias("arrow"),
        fixed(F.col("value"), 4).alias("value"),
        F.lit("±").alias("pm"),
        F.when(F.col("stderr").isNull(), "   N/A").otherwise(fixed(F.col("stderr"), 4)).alias("stderr"),
    )


def print_order(edges: DataFrame) -> DataFrame:
    """Every node with its indented alias and the path that orders it below its group."""
    child = edges.select(F.col("child").alias("ancestor")).distinct()
    roots = edges.join(child.withColumnRenamed("ancestor", "parent"), "parent", "left_anti").select("parent").distinct()
    below = descendants(edges).join(roots.withColumnRenamed("parent", "ancestor"), "ancestor", "left_semi")
    top = roots.select(F.col("parent").alias("node"), F.lit(0).alias("depth"), F.col("parent").alias("path"))
    every = top.unionByName(below.select("node", "depth", "path"))
    alias = F.when(F.col("depth") > 0, F.concat(F.expr("repeat(' ', depth)"), F.lit("- "), F.col("node"))).otherwise(F.col("node"))
    return every.select("node", "depth", "path", alias.alias("alias"))


def flat_choices(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document of a multiple-choice task: input, listed choices, raw prediction."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "continuation"))), lambda x: F.concat(x["idx"].cast("string"), F.lit(". "), x["continuation"])), "\n")
    return rows.groupBy(*keys).agg(
        F.min_by("context", "idx").alias("data"),
        listed.alias("choices"),
        F.max_by("idx", F.struct(F.col("loglik"), -F.col("idx"))).alias("raw_predictions"),
        F.max("gold").alias("labels"),
    ).withColumns({"input_len": F.length("data").cast("long"), "output_type": F.lit("multiple_choice")})


def flat_likelihood(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Likelihood rows with the sentence that reports probability and greediness."""
    said = F.concat(
        F.lit("log probability of continuation is "), F.col("loglik").cast("string"),
        F.lit(" \n\ncontinuation will "), F.when(F.col("is_greedy"), "be").otherwise("not be"), F.lit(" generated with greedy sampling"),
    )
    return rows.select(*keys, F.col("context").alias("data"), F.col("continuation").alias("labels"), said.alias("raw_predictions"),
                       F.length("context").cast("long").alias("input_len"), F.lit("loglikelihood").alias("output_type"))


def metric_summary(results: DataFrame) -> DataFrame:
    """``task/metric`` keys, without the name of the default filter."""
    name = F.regexp_replace(F.concat("metric", F.lit(","), "filter"), ",none$", "")
    return results.select(F.concat("task", F.lit("/"), name).alias("key"), "value")


def sample_counts(docs: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Original and effective number of samples."""
    n = F.count(F.lit(1))
    return docs.groupBy(*by).agg(n.alias("original"), F.least(n, F.lit(limit).cast("long")).alias("effective"))


def task_catalogue(docs: DataFrame, task: str, split: str) -> DataFrame:
    """Splits and document counts per task."""
    per = docs.groupBy(task, split).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(task).agg(F.array_sort(F.collect_list(split)).alias("splits"), F.sum("n").alias("n_docs"))


def match_tasks(names: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Names that match any shell-style pattern."""

    def regex(p: str) -> str:
        return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$"

    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(column).rlike("(?s)" + regex(p))
    return names.where(hit).select(column).distinct()


def expand_tags(selected: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """Groups and tags replaced by the leaves under them; plain tasks stay."""
    inner = edges.select(F.col("parent").alias(column)).distinct()
    below = descendants(edges).join(inner.withColumnRenamed(column, "node"), "node", "left_anti")
    leaves = selected.join(below.select(F.col("ancestor").alias(column), "node"), column).select(F.col("node").alias(column))
    return selected.join(inner, column, "left_anti").unionByName(leaves).distinct()
