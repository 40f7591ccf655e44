"""Requests and responses: joins, caching, de-duplication, batching, windows, model comparison."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.ngrams import bind
from evalspark.operators.ordering import with_position
from evalspark.session import broadcast_if_small, ensure_checkpoint_dir


def attach_responses(requests: DataFrame, responses: DataFrame, doc_keys: list[str], fields: list[str]) -> DataFrame:
    """Responses beside their requests, one row per document with the answers in request order.

    A document has as many requests as it has choices, so the collected array stays small.
    """
    joined = requests.join(responses, [*doc_keys, "idx"])
    return joined.groupBy(*doc_keys).agg(F.array_sort(F.collect_list(F.struct("idx", *fields))).alias("answers"))


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str, answer: str, sampled: Column) -> DataFrame:
    """Requests with the cached answer and a ``hit`` flag, in one join.

    Sampled requests never hit: they join under a key of their own that no cache entry has, which
    also spreads them over the cluster as a common NULL key would not.
    """
    known = cache.select(F.col(key).alias("_k"), F.col(answer).alias(f"cached_{answer}"), F.lit(True).alias("_hit"))
    own = F.concat(F.lit("sampled:"), F.xxhash64(*requests.columns).cast("string"))
    usable = F.when(sampled, own).otherwise(F.col(key))
    return requests.join(known, usable == F.col("_k"), "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def extend_cache(cache: DataFrame, answered: DataFrame, key: str, answer: str, order: str, sampled: Column) -> DataFrame:
    """The cache with the answers it did not hold yet (the earliest per request), sampled ones left out."""
    fresh = answered.where(~sampled).groupBy(key).agg(F.min_by(answer, order).alias(answer))
    return cache.select(key, answer).unionByName(fresh.join(cache.select(key), key, "left_anti"))


def answer_once(requests: DataFrame, key: str, scorer, answer: str) -> DataFrame:
    """Run ``scorer`` over distinct requests only and give every duplicate the same answer."""
    distinct = requests.dropDuplicates([key])
    return requests.join(scorer(distinct).select(key, answer), key)


def batches(requests: DataFrame, length: Column, order: list[str], size: int, group: list[str] | None = None) -> DataFrame:
    """Longest-first order cut into batches of ``size`` (inside each group of generation settings)."""
    placed = with_position(requests.withColumn("_neg", -length), ["_neg", *order], group).drop("_neg")
    return placed.withColumn("batch_id", F.floor(F.col("pos") / size))


def shared_prefix(requests: DataFrame, ids: list[str], context: Column, continuation: Column) -> tuple[DataFrame, DataFrame]:
    """Requests keyed by context + continuation without its last token, and one representative each.

    The representative is the longest continuation (the first request on ties); its answer is fanned
    out by joining the keyed requests back on ``prefix_key``.
    """
    body = F.concat(context, F.slice(continuation, 1, F.greatest(F.size(continuation) - 1, F.lit(0))))
    keyed = requests.withColumns({"prefix_key": F.sha2(F.to_json(body), 256), "n_cont": F.size(continuation).cast("long")})
    rank = F.struct(F.col("n_cont"), *[(-F.col(i)).alias(i) for i in ids])
    chosen = keyed.groupBy("prefix_key").agg(
        F.max_by(F.struct(*ids, "n_cont"), rank).alias("r"), F.count(F.lit(1)).alias("n_sharing")
    )
    return keyed, chosen.select("prefix_key", "r.*", "n_sharing")


def rolling_windows(tokens: Column, prefix: Column, max_len: int, context_len: int) -> Column:
    """``array<struct<input, pred>>``: the first window predicts as much as fits, each later one
    ``max_len - context_len + 1`` tokens with what precedes them as context."""
    step = max_len - context_len + 1

    def cut(t: Column) -> Column:
        n = F.size(t)
        first_len = F.least(F.lit(max_len), n)
        first = F.struct(
            F.concat(F.array(prefix), F.slice(t, F.lit(1), F.greatest(first_len - 1, F.lit(0)))).alias("input"),
            F.slice(t, F.lit(1), first_len).alias("pred"),
        )
        starts = F.when(n > max_len, F.sequence(F.lit(max_len), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

        def later(p: Column) -> Column:
            end = F.least(n, p + step)
            return F.struct(
                F.slice(t, F.greatest(end - max_len, F.lit(1)), F.lit(max_len)).alias("input"),
                F.slice(t, p + 1, end - p).alias("pred"),
            )

        return F.when(n > 0, F.concat(F.array(first), F.transform(starts, later)))

    return bind(tokens, cut)


def disjoint(window: Column) -> Column:
    """Input of a window without the tokens that are also predicted."""
    return F.slice(window["input"], F.lit(1), F.greatest(F.size(window["input"]) - (F.size(window["pred"]) - 1), F.lit(0)))


def truncate(tokens: Column, limit: int, side: str = "left") -> Column:
    """The last (``left``), first (``right``) or both-ends (``middle``) ``limit`` tokens."""
    n = F.size(tokens)
    last = lambda t, k: F.slice(t, F.greatest(F.size(t) - k + 1, F.lit(1)), F.lit(k))
    if side == "left":
        return bind(tokens, lambda t: last(t, limit))
    if side == "right":
        return F.slice(tokens, 1, limit)
    return bind(tokens, lambda t: F.concat(F.slice(t, 1, limit // 2), last(t, limit - limit // 2)))


def compare_models(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Two models' values side by side on the keys they share."""
    left = a.select(*on, F.col(value).alias("value_a"))
    right = b.select(*on, F.col(value).alias("value_b"))
    return left.join(right, on).withColumn("difference", F.col("value_b") - F.col("value_a"))


def common_tasks(results: DataFrame, task: str, model: str) -> DataFrame:
    """Tasks that every model has."""
    pairs = results.select(task, model).distinct()
    n_models = pairs.agg(F.countDistinct(model).alias("n_models"))
    per_task = pairs.groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    return per_task.join(F.broadcast(n_models), per_task["n"] == n_models["n_models"], "left_semi").select(task)


def completeness(frozen: DataFrame, scored: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Every id of the three exports with what is wrong with it (``ok`` when nothing is)."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    c = lambda n: F.coalesce(n, F.lit(0))
    all3 = counted(frozen, "n_frozen").join(counted(scored, "n_scored"), key, "full_outer").join(counted(raw, "n_raw"), key, "full_outer")
    all3 = all3.select(key, *[c(n).alias(n) for n in ("n_frozen", "n_scored", "n_raw")])
    defect = (
        F.when(F.col("n_frozen") == 0, "unexpected")
        .when(F.col("n_frozen") > 1, "duplicate frozen")
        .when(F.col("n_raw") == 0, "missing raw")
        .when(F.col("n_raw") > 1, "duplicate raw")
        .when(F.col("n_scored") == 0, "missing scored")
        .when(F.col("n_scored") > 1, "duplicate scored")
        .otherwise("ok")
    )
    return all3.withColumn("defect", defect)


def request_key(task, shots=0, rank=0, world=1, template="", tokenizer="") -> Column:
    """Key of a set of requests: the digest of everything that shapes it. Arguments are columns or values."""
    parts = ["requests-", task, "-", shots, "shot-rank", rank, "-world", world, "-", template, "-", tokenizer]
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat(*[c.cast("string") for c in cols]), 256)


class RequestStore:
    """Built request sets of many keys in one table, partitioned by key and build, under a manifest.

    A build writes its rows as a new partition of each key and then appends one manifest row for each key, in one file:
    that file is the commit. Rows of a build that failed before it are never read, and readers of the build before keep
    their files. The newest manifest row of a key decides: ``live`` names its build, otherwise the key is deleted. Repeating
    a failed write replaces its own partitions alone (dynamic overwrite). ``vacuum`` removes what no reader can reach.

    A key is any non-null string. All sets of a store have the columns of the first one, or ``schema`` where that is given
    (needed only to read a store all of whose sets are empty); ``cache_key`` and ``build`` are the store's own columns. One
    writer for a key at a time; of two, the later wins.
    """

    KEY, BUILD = "cache_key", "build"
    MANIFEST = "cache_key string, build string, step long, n_rows long, live boolean"

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.rows_path, self.manifest_path = f"{self.root}/rows", f"{self.root}/manifest"

    @staticmethod
    def key(task: str, shots: int, rank: int, world: int, template: str = "", tokenizer: str = "") -> str:
        """``request_key`` of plain values."""
        text = f"requests-{task}-{shots}shot-rank{rank}-world{world}-{template}-{tokenizer}"
        return hashlib.sha256(text.encode()).hexdigest()

    def _file_system(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        p, fs = self._file_system(path)
        return fs.exists(p)

    def manifest(self) -> DataFrame:
        """``cache_key, build, step, n_rows, live``: the newest row of each key, deleted keys included."""
        if not self._there(self.manifest_path):
            return self.spark.createDataFrame([], self.MANIFEST)
        rows = self.spark.read.schema(self.MANIFEST).parquet(self.manifest_path)
        last = F.max_by(F.struct("build", "step", "n_rows", "live"), F.struct("step", "build")).alias("last")
        return rows.groupBy(self.KEY).agg(last).select(self.KEY, "last.*")

    def keys(self) -> DataFrame:
        """``cache_key, build, n_rows`` of the sets that can be read."""
        return self.manifest().where("live").select(self.KEY, self.BUILD, "n_rows")

    def _commit(self, entries: DataFrame) -> None:
        """Append manifest rows (``cache_key, build, n_rows, live``) as one file, after all earlier ones."""
        step = (self.manifest().agg(F.max("step")).first()[0] or 0) + 1
        rows = entries.select(self.KEY, "build", F.lit(step).cast("long").alias("step"), "n_rows", "live")
        rows.coalesce(1).write.mode("append").parquet(self.manifest_path)

    def _stored(self, builds: DataFrame) -> DataFrame:
        """Rows of the given ``cache_key, build`` pairs; the pairs prune partitions."""
        schema = self.schema
        if schema is None:
            written = self.spark.read.parquet(self.rows_path).schema  # fails where nothing but empty sets was stored
            schema = T.StructType([f for f in written if f.name not in (self.KEY, self.BUILD)])
        whole = T.StructType([*schema, T.StructField(self.KEY, T.StringType()), T.StructField(self.BUILD, T.StringType())])
        if not self._there(self.rows_path):
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).parquet(self.rows_path)
        return rows.join(broadcast_if_small(builds), [self.KEY, self.BUILD])

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """``cache_key`` and the columns of the sets: all of them, or those of ``keys``."""
        builds = self.keys().select(self.KEY, self.BUILD)
        if keys is not None:
            builds = builds.join(keys.select(self.KEY).distinct(), self.KEY, "left_semi")
        return self._stored(builds).drop(self.BUILD)

    def put(self, keys: DataFrame, rows: DataFrame) -> None:
        """Store ``rows`` (with ``cache_key``) as the newest sets of ``keys``; a key without rows is an empty set. Rows of
        other keys are left out. Hot keys are spread over several files, small ones share a task."""
        build = f"b{uuid.uuid4().hex}"
        keys = keys.select(self.KEY).distinct()
        mine = rows.join(broadcast_if_small(keys), self.KEY, "left_semi").withColumn(self.BUILD, F.lit(build))
        out = mine.hint("rebalance", F.col(self.KEY)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(self.KEY, self.BUILD).parquet(self.rows_path)
        places = self.spark.read.schema(f"{self.KEY} string, {self.BUILD} string").parquet(self.rows_path)
        counts = places.where(F.col(self.BUILD) == build).groupBy(self.KEY).agg(F.count(F.lit(1)).alias("n"))
        n = F.coalesce("n", F.lit(0).cast("long")).alias("n_rows")
        self._commit(keys.join(counts, self.KEY, "left").select(self.KEY, F.lit(build).alias("build"), n, F.lit(True).alias("live")))

    def ensure(self, keys: DataFrame, build: Callable[[DataFrame], DataFrame], refresh: bool = False) -> DataFrame:
        """The sets of ``keys``; ``build(missing keys)`` makes those that are not stored, or all of them on ``refresh``."""
        missing = keys if refresh else keys.join(self.keys(), self.KEY, "left_anti")
        if not missing.isEmpty():
            ensure_checkpoint_dir(self.spark)
            missing = missing.checkpoint()  # the manifest it was read from changes
            self.put(missing, build(missing))
        return self.read(keys)

    def drop(self, keys: DataFrame) -> None:
        """Delete the sets of ``keys``; their rows stay until ``vacuum``."""
        gone = self.keys().join(keys.select(self.KEY).distinct(), self.KEY, "left_semi")
        self._commit(gone.select(self.KEY, "build", "n_rows", F.lit(False).alias("live")))

    def vacuum(self) -> int:
        """Remove partitions that are not a live build; returns their number. Not beside a running build or reader."""
        if not self._there(self.rows_path):
            return 0
        live = {(r[0], r[1]) for r in self.keys().select(self.KEY, self.BUILD).toLocalIterator()}
        root, fs = self._file_system(self.rows_path)
        gone = 0
        for key in fs.listStatus(root):
            for part in fs.listStatus(key.getPath()) if key.isDirectory() else []:
                names = [p.getName().split("=", 1)[-1] for p in (key.getPath(), part.getPath())]
                if (unquote(names[0]), names[1]) not in live:
                    gone += fs.delete(part.getPath(), True)
        return gone

    # one key at a time

    def _one(self, key: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(key).alias(self.KEY))

    def exists(self, key: str) -> bool:
        return not self.keys().where(F.col(self.KEY) == key).isEmpty()

    def load_or_build(self, key: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        return self.ensure(self._one(key), lambda keys: build().withColumn(self.KEY, F.lit(key)), refresh).drop(self.KEY)

    def delete(self, key: str) -> None:
        self.drop(self._one(key))
