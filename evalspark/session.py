"""Session construction, checkpointing and partition-sizing helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(master: str | None = None, app: str = "evalspark", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the plans assume; a cluster passes ``master=None``."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        # Python workers of a local master find the package beside this file
        here, known = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")
        if here not in known.split(os.pathsep):
            os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known]))
        b = b.master(master).config("spark.driver.memory", "16g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is configured, a temporary one in local mode and an error on
    a cluster, whose executors would not see each other's files."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="spark-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute on ``keys`` when the input has fewer partitions than the cluster has slots.

    A no-op on a large multi-file input; on one small file it keeps text work from running in one task.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)


def distribute(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute on ``keys`` into a fixed number of partitions before row-expanding work.

    A fixed number is not merged again by adaptive execution, which sees only the small input and
    not what each row expands to.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def _width(field: T.StructField) -> Column:
    """Bytes of a value, about; nested values by their JSON text."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def fits(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes."""
    width = sum((_width(f) for f in df.schema), F.lit(0)).cast("long")
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``broadcast`` hint only after rows and bytes have been checked; otherwise the plain frame."""
    return F.broadcast(df) if fits(df, max_rows) else df


def settle(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Compute a reduced result once into the shared checkpoint folder; broadcast it if it is small.

    For frames that are costly to derive and are joined back to their large source: the checked
    broadcast keeps the source's rows (whole texts) from being shuffled.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return broadcast_if_small(df.checkpoint(), max_rows)
