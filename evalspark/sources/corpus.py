"""Corpus sources and sinks: JSON lines, plain text, tolerant reads, pinned writes, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.ordering import running_sum
from evalspark.operators.requests import ordered_digest
from evalspark.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, text_key: str = "text", separator: str = "\n\n") -> DataFrame:
    """``text, meta``: lines are bare JSON strings or objects whose text may be a list of paragraphs.

    The codec follows the file name (gz, bz2, lz4, zst where the Hadoop native library has it).
    """
    v = F.try_parse_json("value")
    raw = spark.read.text(path).select(v.alias("v"))
    field = F.try_variant_get("v", f"$.{text_key}", "variant")
    kind = F.schema_of_variant(field)
    text = (
        F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
        .when(kind.startswith("ARRAY"), F.array_join(F.try_variant_get("v", f"$.{text_key}", "array<string>"), separator))
        .otherwise(F.try_variant_get("v", f"$.{text_key}", "string"))
    )
    return raw.select(text.alias("text"), F.try_variant_get("v", "$.meta", "map<string,string>").alias("meta"))


def write_jsonl(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """``text`` and ``meta`` as JSON lines."""
    df.select("text", "meta").write.option("compression", compression).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_lines(df: DataFrame, column: str, path: str, compression: str = "gzip") -> None:
    df.select(F.col(column).alias("value")).write.option("compression", compression).text(path)


def read_split(spark: SparkSession, path: str, split: str | None = None, column: str = "split") -> DataFrame:
    """A dataset table, optionally one split of it (the filter reaches the scan)."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col(column) == split)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant JSON-lines read: unreadable or half-written lines keep their text in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_report(records: DataFrame) -> DataFrame:
    """Readable and skipped records per file."""
    bad = F.col("_corrupt").isNotNull()
    return records.groupBy(F.input_file_name().alias("file")).agg(F.count(F.when(~bad, 1)).alias("readable"), F.count(F.when(bad, 1)).alias("skipped"))


def file_statistics(df: DataFrame, file: str, text: str) -> DataFrame:
    """Documents and characters per file, and the global offset of its first document."""
    per = df.groupBy(file).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length(text)).alias("characters"))
    placed = running_sum(per, [file], "documents")
    return placed.select(file, "documents", "characters", (F.col("running") - F.col("documents")).alias("first_offset"))


def table_digest(df: DataFrame, order: list[str], fanout: int = 4096) -> str:
    """Digest of all rows in a unique order: a hash over row hashes, block by block."""
    rows = df.select(*order, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("_d"))
    got = ordered_digest(rows, order, "_d", fanout=fanout).first()
    return got[0] if got else ""


def write_pinned(df: DataFrame, path: str, order: list[str], pinned: str, fanout: int = 4096) -> None:
    """Write a prepared table only if its digest is the pinned one."""
    found = table_digest(df, order, fanout)
    if found != pinned:
        raise ValueError(f"prepared table has digest {found}, expected {pinned}")
    df.write.mode("overwrite").parquet(path)
