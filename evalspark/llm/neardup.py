"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide every pair."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import arrow_pass, components, cut_lineage, hash_texts, mix
from evalspark.session import broadcast_if_small

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Rows that may be broadcast; they have fixed-width columns of less than 100 bytes.
SMALL = 200_000
_BLOCK_SETS, _BLOCK_SHINGLES = 512, 400_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, so the fewest false candidates, that find a pair at ``threshold``
    with probability ``recall``, from at most ``most`` hashes."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold**rows < 1 else 1
        if bands * rows <= most:
            return bands, rows
    return most, 1


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``width`` words; a shorter text with a word is one window."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(width, len(words))):
        out = mix(out + words[j : j + n] * _ODD[j])
    return np.unique(out)


_ODD = np.random.default_rng(23).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` minima; the band's number is part of it."""
    rng = np.random.default_rng(29)
    times = (rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 2048):
        least = np.minimum(least, mix_rows(grams[at : at + 2048], times))
    out = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(bands, rows).T:
        out = mix(out + row)
    return out.view(np.int64)


def mix_rows(grams: np.ndarray, times: np.ndarray) -> np.ndarray:
    h = grams[None, :] * times
    h ^= h >> np.uint64(32)
    h *= times
    return h.min(axis=1)


def signatures(df: DataFrame, bands: int, rows: int, text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, text_key (64-bit hash of the text), digest of the n-gram set, n_grams and band hashes of each row."""

    def run(cols: dict) -> dict:
        texts = [(t or "").encode() for t in cols["text"]]
        n, digest, hashes = [0] * len(texts), [b""] * len(texts), [None] * len(texts)
        for i, words in hash_texts(texts):
            grams = shingles(words, width)
            n[i] = len(grams)
            if len(grams):
                digest[i] = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                hashes[i] = band_hashes(grams, bands, rows)
        return {"doc_id": cols["doc_id"], "text_key": cols["text_key"], "digest": digest, "n_grams": n, "bands": hashes}

    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    return arrow_pass(own, run, "doc_id long, text_key long, digest binary, n_grams long, bands array<long>")


def _links(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(root position, weight of partners) of each set; pairs on one side count only if all sets are on that side."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    both = np.zeros((m, m), np.float32)
    if m == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        owner = np.repeat(np.arange(m), size)
        _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = column.reshape(-1)
        shared = often > 1
        place = np.cumsum(shared) - 1
        use = shared[column]
        owner, column = owner[use], place[column[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        step = max(256, (8 << 20) // m)
        for at in range(0, int(shared.sum()), step):
            lo, hi = np.searchsorted(column, (at, at + step))
            has = np.zeros((m, min(step, int(shared.sum()) - at)), np.float32)
            has[owner[lo:hi], column[lo:hi] - at] = 1
            both += has @ has.T
    near = both.astype(np.int64) * (den + num) >= num * (size[:, None] + size[None, :])
    np.fill_diagonal(near, False)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    root = np.arange(m)
    while True:
        low = np.minimum(root, np.where(near, root[None, :], m).min(axis=1))
        low = low[low]
        if (low == root).all():
            return root, near.astype(np.int64) @ weight
        root = low


def near_duplicates(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """One row for each row of ``df``: doc_id, text_key, class_id, n_links, n_grams, first.

    A link is a Jaccard similarity of at least ``threshold`` between sets of ``width``-word n-grams. ``class_id`` is
    the least doc_id of the documents joined by links; ``n_links`` counts the other rows linked to this one, equal
    texts included; ``first`` marks the rows that stand for their class. Texts without a word have no links.

    Rows with one n-gram set are one set from the start. Sets that share a band hash are candidates; only a bucket's
    least and greatest set are aggregated, so a hot bucket is combined before the shuffle. Joined candidates form
    groups. Each group's n-gram sets travel once and meet in one task; a group of many or large sets is dealt into
    blocks, and each pair of blocks meets in a task of its own, which returns counts and not pairs. So every pair in a
    group is decided on its full sets, and no pair is emitted. Cut points: 512 sets or 400,000 n-grams a block.
    """
    bands, rows = choose_bands(threshold, recall)
    ratio = Fraction(str(threshold))
    sig = cut_lineage(signatures(df, bands, rows, text, width))
    short = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    keys = sig.where("n_grams > 0").select(short.alias("node"), F.explode("bands").alias("bucket"))
    hot = keys.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket", "low")
    hot = cut_lineage(hot)
    edges = keys.join(broadcast_if_small(hot, SMALL), "bucket").select(F.col("node").alias("a"), F.col("low").alias("b"))
    groups = components(edges)
    # one row for each distinct set of a group, and the row of df that shows it
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    found = sig.select("doc_id", "text_key", "digest", "n_grams", short.alias("node")).join(broadcast_if_small(groups, SMALL), "node")
    sets = found.groupBy("digest").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("root").alias("root"), F.min("n_grams").alias("n"))
    sets = cut_lineage(sets)
    parts = sets.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / _BLOCK_SETS), F.ceil(F.sum("n") / _BLOCK_SHINGLES)).cast("long").alias("parts"))
    dealt = sets.join(broadcast_if_small(parts, SMALL), "root").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("parts")))
    wanted = dealt.select("digest", "weight", "root", "parts", "block", F.coalesce(F.col("rep.d"), F.lit(-1)).alias("__d"), F.col("rep.n").alias("__n"), F.col("rep.k").alias("__k"))
    texts = df.select(F.col("doc_id").cast("long").alias("__id"), F.col(text).alias("text"))
    texts = texts.select(F.coalesce("__id", F.lit(-1)).alias("__d"), F.col("__id").isNull().alias("__n"), F.xxhash64("text").alias("__k"), "text")
    shown = texts.join(broadcast_if_small(wanted, SMALL), ["__d", "__n", "__k"]).select("text", "digest", "weight", "root", "parts", "block")

    def grams(cols: dict) -> dict:
        made = [None] * len(cols["text"])
        for i, words in hash_texts([(t or "").encode() for t in cols["text"]]):
            made[i] = shingles(words, width).view(np.int64)
        return {k: v for k, v in cols.items() if k != "text"} | {"grams": pa.array(made, pa.list_(pa.int64()))}

    full = arrow_pass(shown, grams, "digest binary, weight long, root long, parts long, block long, grams array<long>")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    units = full.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    units = units.select("root", "lo", "hi", (F.col("block") == F.col("hi")).alias("side"), "digest", "weight", "grams")
    units = units.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows_, out = None, {}, []
        for b in batches:
            for r in zip(*[b[c].to_pylist() for c in ("root", "lo", "hi", "side", "digest", "weight")], b["grams"], strict=True):
                if r[:3] != now:
                    out += _decided(rows_, now, ratio)
                    now, rows_ = r[:3], {}
                rows_[r[4]] = (r[3], r[5], np.asarray(r[6].values, dtype=np.int64))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_LINK)
                out = []
        out += _decided(rows_, now, ratio)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_LINK)

    decided = cut_lineage(units.mapInArrow(verify, "digest binary, root binary, links long"))
    joined = components(decided.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    counts = decided.groupBy("digest").agg(F.sum("links").alias("links"))
    own = sig.where("n_grams > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("rep"), F.min("doc_id").alias("least"))
    small = own.join(joined.select(F.col("node").alias("digest"), "root"), "digest", "left").join(counts, "digest", "left").where("copies > 1 or links is not null")
    small = cut_lineage(small.withColumn("root", F.coalesce("root", "digest")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).select("digest", "root", "n_links", "rep", "least"))
    named = small.join(small.groupBy("root").agg(F.min("rep").alias("class_rep"), F.min("least").alias("class_id")), "root").select("digest", "class_id", "class_rep", "n_links")
    out = sig.select("doc_id", "text_key", "digest", "n_grams").join(broadcast_if_small(named, SMALL), "digest", "left")
    alone = F.col("n_links").isNull()
    return out.select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "n_grams",
        (alone | (F.col("class_rep") == key)).alias("first"),
    )


_LINK = pa.schema([("digest", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])


def _decided(rows: dict, unit: tuple | None, ratio: Fraction) -> list[dict]:
    """Linked sets of one unit (a group, or two blocks of it); two rows of one set count once. Two blocks have only
    pairs across them: if one of the two is empty, the pairs of the other are counted in its own unit."""
    if len(rows) < 2:
        return []
    names = sorted(rows)
    side = np.array([rows[d][0] for d in names]) if unit[1] != unit[2] else np.zeros(len(names), bool)
    if unit[1] != unit[2] and side.all() == side.any():
        return []
    root, links = _links([rows[d][2] for d in names], side, np.array([rows[d][1] for d in names]), ratio.numerator, ratio.denominator)
    return [{"digest": d, "root": names[root[i]], "links": int(links[i])} for i, d in enumerate(names) if links[i]]


def one_per_class(df: DataFrame, **how) -> DataFrame:
    """``df`` with one row of each class of near duplicates, its least doc_id; rows without links all stay."""
    found = near_duplicates(df, **how)
    gone = cut_lineage(found.where("not first").select("doc_id", "text_key").distinct())
    again = cut_lineage(found.where("first and n_links > 0").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"))
    text = how.get("text", "text")
    keyed = df.withColumn("__key", F.xxhash64(F.col(text)))
    on = lambda side: keyed["doc_id"].cast("long").eqNullSafe(side["doc_id"]) & (keyed["__key"] == side["text_key"])
    left = keyed.join(broadcast_if_small(gone, SMALL), on(gone), "left_anti")
    if again.limit(1).count():
        repeated = keyed.join(broadcast_if_small(again, SMALL), on(again), "left_semi").dropDuplicates(["doc_id", "__key"])
        left = left.join(broadcast_if_small(again, SMALL), on(again), "left_anti").unionByName(repeated)
    return left.select(*[F.col(f"`{c}`") for c in df.columns])
