"""Structured Streaming jobs over an append-only response log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalspark.functions.rows import ngram_run_counts, ngram_runs
from evalspark.operators.decontam import buckets_for, clean_tokens
from evalspark.session import spread


def read_log(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A file stream; new files are picked up in batches."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def progress(log: DataFrame, by: list[str], watermark: str | None = None, time: str = "created_at") -> DataFrame:
    """Counts over requests seen so far, each counted once.

    Without a watermark every distinct hash stays in state; with one, duplicates are recognised
    within that delay and older hashes are dropped.
    """
    known = log.where(F.coalesce("request_hash", F.lit("")) != "")
    if watermark:
        known = known.withColumn(time, F.col(time).cast("timestamp"))
    once = known.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["request_hash"]) if watermark else known.dropDuplicates(["request_hash"])
    return once.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process everything available into a table of counts at ``out``.

    Each batch writes the groups whose count changed, with their new count, into a folder of its own number. A batch
    that failed half-way is done again from the state of the one before and replaces its folder, so nothing is counted
    twice and the driver holds no rows. ``latest`` reads the table, ``compact`` shortens it.
    """
    counts.sparkSession.createDataFrame([], counts.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest(spark: SparkSession, out: str, by: list[str], count: str = "n") -> DataFrame:
    """The counts as of the last batch that touched each group."""
    return spark.read.parquet(out).groupBy(*by).agg(F.max_by(count, "batch").alias(count))


def compact(spark: SparkSession, out: str, into: str, by: list[str], count: str = "n") -> int:
    """Write the latest counts as one folder of a new table at ``into``, numbered as the last batch it holds, and return
    that number. Later batches written to ``into`` take over from it; ``out`` is left as it is."""
    last = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    latest(spark, out, by, count).write.mode("overwrite").parquet(f"{into}/batch={last}")
    return last


def export_once(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once export: each batch overwrites its own folder, so a repeated batch after a crash
    replaces what it had written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["request_hash"]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def exported(spark: SparkSession, out: str, order: str) -> DataFrame:
    """The exported responses, one per request over all batches."""
    rows = spark.read.parquet(out)
    fields = [c for c in rows.columns if c not in ("request_hash", "batch")]
    return rows.groupBy("request_hash").agg(F.min_by(F.struct(*fields), order).alias("r")).select("request_hash", "r.*")


def ngram_stream(docs: DataFrame, n: int, out: str, checkpoint: str) -> StreamingQuery:
    """Resumable n-gram generation: the checkpoint remembers which files are done, and a batch that is done again replaces
    its folder.

    The table holds the distinct n-grams of each document as runs of neighbours (``ngram_runs``). Texts are spread over all
    tasks if a batch has fewer parts than that. ``ngram_counts`` reads the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        runs = ngram_runs(spread(batch, "doc_id"), ["doc_id"], clean_tokens(F.col("text")), n)
        runs.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={batch_id}")

    q = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ngram_counts(spark: SparkSession, out: str, n: int) -> DataFrame:
    """``(ngram, n_docs)`` over all batches of ``ngram_stream``."""
    runs = spark.read.parquet(out)
    return ngram_run_counts(runs, n, buckets_for(runs.select(F.col("words").alias("text"))))
