"""Result documents and per-sample logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_results(results: DataFrame, path: str) -> None:
    """One JSON document per task with its metrics as a map."""
    key = F.concat("metric", F.lit(","), "filter")
    doc = results.groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.col("value"))))).alias("results"), F.max("n").alias("samples"))
    doc.write.json(path)


def flatten_arguments(arguments: Column) -> Column:
    """``array<array<string>>`` as ``gen_args_i → arg_j → value``."""
    inner = lambda args: F.map_from_entries(F.transform(args, lambda a, j: F.struct(F.concat(F.lit("arg_"), j.cast("string")), a)))
    return F.map_from_entries(F.transform(arguments, lambda args, i: F.struct(F.concat(F.lit("gen_args_"), i.cast("string")), inner(args))))


def save_samples(samples: DataFrame, path: str) -> None:
    """Per-sample log partitioned by task, arguments flattened, responses and targets as text."""
    samples.withColumns(
        {"arguments": flatten_arguments(F.col("arguments")), "resps": F.col("resps").cast("array<string>"), "target": F.col("target").cast("string")}
    ).write.partitionBy("task").json(path)


def file_task(name: Column) -> Column:
    """Task between the first and the last underscore of a log's file name."""
    return F.regexp_extract(name, r"(?s)^[^_]*_(.*)_[^_]*$", 1)


def file_datetime(name: Column) -> Column:
    return F.replace(F.regexp_extract(name, r"([^_]*)$", 1), F.lit(".jsonl"), F.lit(""))


def latest_per_task(files: DataFrame, model: str, name: str) -> DataFrame:
    """The newest log of every (model, task) by the date in its file name."""
    f = files.select(model, F.col(name).alias("name"), file_task(F.col(name)).alias("task"), file_datetime(F.col(name)).alias("datetime"))
    return f.groupBy(model, "task").agg(F.max_by("name", "datetime").alias("latest"))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest log of each task under ``path``."""
    rows = spark.read.json(path).withColumn("_file", F.input_file_name())
    base = F.regexp_extract("_file", r"([^/]*)$", 1)
    newest = rows.select(base.alias("name")).distinct().select(F.lit(0).alias("model"), "name")
    keep = latest_per_task(newest, "model", "name").select(F.col("latest").alias("_base"))
    return rows.withColumn("_base", base).join(keep, "_base", "left_semi").drop("_file", "_base")
