"""Helpers shared by the training-data operators: tables, Arrow passes, word hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import ensure_checkpoint_dir

#: Words are runs of anything but the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Kinds of bytes: 0 for the six spaces, 1 for all others.
WORDS = np.ones(256, dtype=np.uint8)
WORDS[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = np.ones(1, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel in Arrow batches of at most ``rows`` rows, so that a worker holds little at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """What ``make`` returns, made once in a worker process and kept there for later tasks."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Frees what earlier passes keep in this worker process, which outlives them."""
    _kept.clear()


def arrow_pass(df: DataFrame, fn: Callable[[dict], dict | None], schema: str, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with ``fn`` from the columns of a batch (lists of Python values) to columns of the result.

    Only a pass that ``keeps`` leaves what is kept in its worker processes in place.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        for b in batches:
            if b.num_rows:
                out = fn(b.to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_arrays([as_arrow(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def blocks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` bytes each; a longer text is alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Memory(dict):
    """A dict of bounded size: what was not asked for while half of it filled is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.old = most // 2, {}

    def __missing__(self, key):
        value = self.old[key]
        self[key] = value
        return value

    def make_room(self, n: int) -> None:
        if len(self) + n > self.half:
            self.old = dict(self)
            self.clear()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 64), _STEP, dtype=np.uint64)
        more[0] = 1
        _powers = np.cumprod(more, dtype=np.uint64)
    return _powers


def hash_words(text: bytes, lower: bool = False, kinds: np.ndarray = WORDS, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and length of each word of a text; long texts are read in parts cut at spaces.

    ``kinds`` gives the kind of each byte: a word is a run of bytes of one kind, and kind 0 lies between words.
    """
    hashes, starts, sizes, at = [], [], [], 0
    whole = np.frombuffer(text, dtype=np.uint8)
    while at < len(whole):
        end = min(len(whole), at + part)
        while end < len(whole):
            gap = np.flatnonzero(kinds[whole[end : end + part]] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(whole), end + part)
        x = whole[at:end]
        kind = kinds[x]
        turn = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        size = np.diff(turn, append=len(x))
        words = kind[turn] > 0
        first, size = turn[words], size[words]
        if len(first):
            x = x[kind > 0]
            begin = np.cumsum(size) - size
            where = np.arange(len(x)) - np.repeat(begin, size)
            value = _TABLE[_LOWER[x] if lower else x] * _powers_to(int(size.max()))[where]
            hashes.append(mix(np.add.reduceat(value, begin)))
            starts.append(first + at)
            sizes.append(size)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(sizes)


def hash_texts(texts: list[bytes], lower: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(position, word hashes) of each text; short texts are hashed together."""
    for lo, hi in blocks(texts):
        joined = b" ".join(texts[lo:hi])
        h, starts, _ = hash_words(joined, lower)
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        cuts = np.searchsorted(starts, ends[:-1])
        for i, own in enumerate(np.split(h, cuts)):
            yield lo + i, own


#: Bits of a key filter; it is broadcast as at most 2^18 rows of 16 bytes, whatever the number of keys.
FILTER_BITS = 24


def with_filter(df: DataFrame, keys: DataFrame, key: str, name: str = "__maybe") -> DataFrame:
    """``df`` with a flag that is true for every row whose ``key`` is among ``keys``, and for few others.

    A fixed-size bit filter, so that rows without a partner need not move for a join. With very many keys more rows
    are flagged, never fewer.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    word, place = F.shiftright(bit, 6), bit.bitwiseAND(F.lit(63)).cast("int")
    bits = keys.select(word.alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {1 << FILTER_BITS}) & 63 as int))").alias("__bit"))
    bits = cut_lineage(bits.groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    joined = df.withColumn("__at", word).join(F.broadcast(bits), F.col("__at") == F.col("__word"), "left")
    return joined.withColumn(name, F.coalesce(F.getbit("__bits", place) == 1, F.lit(False))).drop("__at", "__word", "__bits")


def join_many_to_one(df: DataFrame, one: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``df`` left-joined with ``one``, which has a row for each ``key``. Keys that hold more than one in ``share`` rows
    of ``df`` (so at most ``share`` keys) meet a broadcast of just their rows; all others are shuffled by key."""
    counts = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col(key).isNotNull()))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = cut_lineage(counts.where(F.col("__n") * share > max(total, 64 * share)).select(key, F.lit(True).alias("__hot")))
    if not hot.limit(1).count():
        return df.join(one, key, "left")
    flagged = df.join(F.broadcast(hot), key, "left")
    few = F.broadcast(one.join(F.broadcast(hot.select(key)), key, "left_semi"))
    return flagged.where("__hot").drop("__hot").join(few, key, "left").unionByName(flagged.where("__hot IS NULL").drop("__hot").join(one, key, "left"))


def components(edges: DataFrame, rounds: int = 60, hot: bool = False) -> DataFrame:
    """(node, root) of every node of undirected ``edges`` (a, b); root is the least node of the component.

    Every round hangs each node, and the node it hung on, to the least label seen next to it, then follows labels
    one step; paths halve, so that few rounds are needed. Only aggregates by key are shuffled: a node with very many
    edges is combined before the shuffle. Nothing but a count per round reaches the driver. With ``hot``, nodes with
    very many edges and labels of very large components meet their own label by a broadcast.
    """
    follow = join_many_to_one if hot else lambda df, one, key: df.join(one, key, "left")
    both = edges.select("a", "b").where("a != b")
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    label = cut_lineage(label)
    for _ in range(rounds):
        names = label.select(F.col("node").alias("b"), F.col("root").alias("r"))
        near = (follow(both, names, "b") if hot else both.join(names, "b")).groupBy("a").agg(F.min("r").alias("r"))
        seen = label.join(near, label["node"] == near["a"], "left").select("node", "root", F.least("root", "r").alias("low"))
        hung = seen.select(F.col("root").alias("node"), F.col("low").alias("cand")).unionByName(seen.select("node", F.col("low").alias("cand")))
        low = hung.groupBy("node").agg(F.min("cand").alias("low"))
        # one jump: the label of the label
        up = low.select(F.col("node").alias("low"), F.col("low").alias("upper"))
        low = cut_lineage(low) if hot else low
        jumped = follow(low, up, "low").select("node", F.least("low", F.coalesce("upper", "low")).alias("root"))
        old = label.select("node", F.col("root").alias("was"))
        both_labels = cut_lineage(jumped.join(old, "node").select("node", "root", (F.col("root") != F.col("was")).alias("moved")))
        label = both_labels.select("node", "root")
        if not both_labels.where("moved").limit(1).count():
            return label
    raise RuntimeError(f"labels still move after {rounds} rounds")
