"""Rows made from the words of texts, as small Arrow helpers: n-grams, hashes of n-grams, most frequent words.

A task turns each batch of texts into rows of its own; Spark deals, counts and joins the rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import bind

#: Rows that leave a task in one batch, about, and words whose windows are hashed together.
BATCH = 1 << 16
BLOCK = 1 << 18
#: Bytes of runs of n-grams that a task holds until it deals them, and n-grams that are sorted together where they arrive.
HELD = 1 << 25
SORTED = 1 << 20


def _map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from fn(b)

    return df.mapInArrow(run, schema)


def _columns(df: DataFrame, keys: list[str]) -> list[str]:
    return [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]


def ngram_rows(df: DataFrame, keys: list[str], tokens: Column, n: int) -> DataFrame:
    """``(keys…, ngram)``: the distinct n-grams of each row, joined by blanks. Tokens hold no blank."""
    # one text leaves the JVM for each row and not an array; a row without a token has no n-gram
    joined = df.select(*keys, F.nullif(F.array_join(F.transform(tokens, lambda w: F.concat(F.lit(" "), w)), ""), F.lit("")).alias("__words"))

    def rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, own = b.column(len(keys)), b.select(keys)
        owner, grams, sizes = [], [], []

        def done() -> pa.RecordBatch:
            at = pa.array(np.repeat(np.array(owner, np.int64), np.array(sizes, np.int64)))
            return pa.RecordBatch.from_arrays([c.take(at) for c in own.columns] + [pa.array(grams, pa.string())], names=[*keys, "ngram"])

        for i in range(len(words)):
            text = words[i].as_py()
            if text is None:
                continue
            t = text[1:].split(" ")
            found = dict.fromkeys(map(" ".join, zip(*(t[k:] for k in range(n)))))
            owner.append(i)
            sizes.append(len(found))
            grams += found
            if len(grams) >= BATCH:
                yield done()
                owner, grams, sizes = [], [], []
        if grams:
            yield done()

    return _map(joined, rows, ", ".join([*_columns(df, keys), "ngram string"]))


def _coded(texts: pa.StringArray, n: int) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts as numbers, the words they stand for, sizes of the texts in words; text and first word of each n-gram.
    Words are parted by single blanks; a null text has none."""
    words = pc.split_pattern(texts, " ")
    sizes, coded = _sizes(words), words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return codes, coded.dictionary, sizes, *_places(sizes, n)


def _places(sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(owner)) + n <= np.cumsum(sizes)[owner])
    return owner[starts], starts


def _keys(codes: np.ndarray, starts: np.ndarray, n: int, n_words: int) -> list[np.ndarray]:
    """N-grams as a few numbers each, equal for equal n-grams only: as many words in a number as fit."""
    bits = max(1, n_words.bit_length())
    per = 63 // bits
    return [sum(codes[starts + k].astype(np.int64) << (bits * (k - lo)) for k in range(lo, min(n, lo + per))) for lo in range(0, n, per)]


def _part(codes: np.ndarray, starts: np.ndarray, n: int, parts: int) -> np.ndarray:
    """One of ``parts`` for each n-gram, the same for equal ones."""
    if parts == 1:
        return np.zeros(len(starts), np.uint64)
    return _mix(sum(_mix(codes[starts + k].astype(np.uint64) + np.uint64(k << 32)) for k in range(n))) % np.uint64(parts)


def _heads(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Places in ``order``, which sorts ``keys``, where other keys begin."""
    new = np.arange(len(order)) == 0
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return np.flatnonzero(new)


def _runs(texts: pa.StringArray, sizes: np.ndarray, lengths: np.ndarray, owner: np.ndarray, starts: np.ndarray, n: int, *same: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """N-grams of texts as runs of neighbours with equal values of ``same``, and the first n-gram of each; ``lengths`` has
    the bytes of each word."""
    new = np.arange(len(starts)) == 0
    new[1:] |= np.diff(starts) != 1
    for x in (owner, *same):
        new[1:] |= np.diff(x) != 0
    at = np.flatnonzero(new)
    ends = np.cumsum(lengths + 1)  # with the blank after each word
    begins = np.append(0, ends)[np.cumsum(sizes) - sizes]
    moved = (np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts)] - begins)[owner[at]]
    lo = (ends - lengths - 1)[starts[at]] + moved
    size = ends[starts[np.append(at, len(starts))[1:] - 1] + n - 1] - 1 + moved - lo
    to = np.append(0, np.cumsum(size))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[np.repeat(lo - to[:-1], size) + np.arange(to[-1])]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data)), at


def _text_blocks(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about as many bytes of text in column ``at`` as BLOCK words have; a longer text is alone."""
    held, first = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < len(held):
        end = max(first + 1, int(np.searchsorted(held, (held[first - 1] if first else 0) + 8 * BLOCK, "right")))
        yield b.slice(first, end - first)
        first = end


def ngram_runs(df: DataFrame, keys: list[str], tokens: Column, n: int) -> DataFrame:
    """``(keys…, words)``: the distinct n-grams of each row as runs of neighbours, ``words`` joined by blanks: ``k`` words
    hold ``k - n + 1`` n-grams. A run ends where the row has an n-gram again, so words stand about once and not ``n`` times.
    """
    joined = df.select(*keys, bind(tokens, lambda t: F.when(F.size(t) >= n, F.array_join(t, " "))).alias("__words"))

    def rows(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in _text_blocks(whole, len(keys)):
            texts = b.column(len(keys))
            codes, words, sizes, owner, starts = _coded(texts, n)
            if not len(starts):
                continue
            grams = [*_keys(codes, starts, n, len(words)), owner]
            order = np.lexsort(grams)  # equal n-grams stay in order of place
            new = np.sort(order[_heads(grams, order)])
            lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            runs, first = _runs(texts, sizes, lengths, owner[new], starts[new], n)
            own = [b.column(i).take(pa.array(owner[new][first])) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, runs], names=[*keys, "words"])

    return _map(joined, rows, ", ".join([*_columns(df, keys), "words string"]))


def packed_runs(runs: DataFrame, n: int, buckets: int, most_held: int = HELD) -> DataFrame:
    """``(bucket, copies, runs)``: rows of ``ngram_runs`` cut where the anchor changes, for counting in buckets.

    The anchor of an n-gram is its longest word (of equally long ones that of the least hash), so equal n-grams have equal
    anchors, neighbours mostly share theirs, and frequent short words seldom are one. The different runs of a few thousand
    texts that go to one bucket travel as one compressed row for each number of ``copies``.
    """

    def cut(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        codes, words, sizes, owner, starts = _coded(texts, n)
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        data, at = words.buffers()[2], np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
        hashes = np.fromiter((zlib.crc32(data[lo:hi]) for lo, hi in zip(at, at[1:])), np.int64, len(words))
        rank = (((1 << 30) - lengths << 32) | hashes)[codes]
        anchor = rank[starts]
        for k in range(1, n):
            np.minimum(anchor, rank[starts + k], out=anchor)
        runs, first = _runs(texts, sizes, lengths[codes], owner, starts, n, anchor)
        return runs, anchor[first]

    def packed(parts: list[tuple[pa.StringArray, np.ndarray]]) -> pa.RecordBatch:
        coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        anchor, copies = np.zeros(len(coded.dictionary), np.int64), np.bincount(at)
        anchor[at] = np.concatenate([p[1] for p in parts])
        bucket = ((_mix(anchor.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.lexsort((anchor, copies, bucket))
        cuts = _heads([bucket, copies], order)
        lines = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(order)).astype(np.int32)), coded.dictionary.take(pa.array(order)))
        zstd = pa.Codec("zstd", compression_level=3)
        rows = [zstd.compress(x.as_buffer(), asbytes=True) for x in pc.binary_join(lines, "\n")]
        return pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts]].astype(np.int32)), pa.array(copies[order[cuts]]), pa.array(rows, pa.binary())], names=["bucket", "copies", "runs"])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for whole in batches:
            for b in _text_blocks(whole, 0):
                parts.append(cut(b.column(0)))
                held += parts[-1][0].nbytes
                if held > most_held:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    return runs.select("words").mapInArrow(deal, "bucket int, copies long, runs binary")


def ngram_run_counts(runs: DataFrame, n: int, buckets: int, at_once: int = SORTED) -> DataFrame:
    """``(ngram, n_docs)``: each n-gram of the rows of ``ngram_runs``, and in how many rows before them it was.

    N-grams are told apart by their words. They are sorted and written out where their runs arrive, about
    ``at_once`` of them at a time.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, starts, times, held = [], [], [], 0
        for b in batches:
            for copies, row in zip(b.column(1).to_pylist(), b.column(2)):
                text = pa.input_stream(row.as_buffer(), compression="zstd").read_buffer()
                lines = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, text.size], np.int32)), text)
                words = pc.split_pattern(pc.split_pattern(lines, "\n").flatten(), " ")
                chunks.append(words.flatten().dictionary_encode())
                starts.append(_places(_sizes(words), n)[1] + held)
                times.append(np.full(len(starts[-1]), copies, np.int32))
                held += len(chunks[-1])
        if not held:
            return
        coded = pa.chunked_array(chunks).unify_dictionaries()
        vocabulary, codes = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
        starts, times = np.concatenate(starts), np.concatenate(times)
        del chunks, coded
        parts = len(starts) // at_once + 1
        for i in range(parts):
            # equal n-grams are in one part
            mine = np.concatenate([lo + np.flatnonzero(_part(codes, starts[lo : lo + at_once], n, parts) == i) for lo in range(0, len(starts), at_once)])
            if not len(mine):
                continue
            own = starts[mine]
            grams = _keys(codes, own, n, len(vocabulary))
            order = np.lexsort(grams)
            at = _heads(grams, order)
            n_docs, own = np.add.reduceat(times[mine[order]].astype(np.int64), at), own[order[at]]
            for lo in range(0, len(own), BATCH):
                texts = [vocabulary.take(pa.array(codes[own[lo : lo + BATCH] + k])) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*texts, " "), pa.array(n_docs[lo : lo + BATCH])], names=["ngram", "n_docs"])

    return packed_runs(runs, n, buckets).repartitionById(buckets, F.col("bucket")).mapInArrow(count, "ngram string, n_docs long")


_DRAWS = np.random.default_rng(29).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def window_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows of ``n`` word hashes at ``starts``."""
    other, h1, h2 = _mix(words + np.uint64(1)), np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for k in range(n):
        turn = np.uint64(k // 256 * 2)  # longer windows go on with other factors
        h1 += words[starts + k] * (_DRAWS[0, k % 256] + turn)
        h2 += other[starts + k] * (_DRAWS[1, k % 256] + turn)
    return _mix(h1), _mix(h2)


def _hashed(words: pa.Array, n: int, distinct: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and hashes of the n-grams of arrays of word hashes, or of the ``distinct`` ones of a row."""
    sizes = _sizes(words)
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(flat)) + n <= ends[owner])
    owner = owner[starts]
    h1, h2 = window_hashes(flat, starts, n)
    starts = starts - (ends - sizes)[owner]
    if distinct and len(h1):
        order = np.lexsort((h2, h1, owner))
        o, x, y = owner[order], h1[order], h2[order]
        new = np.append(True, (o[1:] != o[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        owner, starts, h1, h2 = o[new], starts[order][new], x[new], y[new]
    return owner, starts, h1, h2


def _sizes(words: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BLOCK words each in column ``at``; a longer text is alone."""
    held, first = np.cumsum(_sizes(b.column(at))), 0
    while first < len(held):
        end = max(first + 1, int(np.searchsorted(held, (held[first - 1] if first else 0) + BLOCK, "right")))
        yield b.slice(first, end - first)
        first = end


def _word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w)).alias("__words")


def ngram_hash_rows(df: DataFrame, keys: list[str], tokens: Column, n: int) -> DataFrame:
    """``(keys…, h1, h2, ngram)``: the distinct n-grams of each row, joined by blanks, and 128 hash bits of each."""
    hashed = df.select(*keys, _word_hashes(tokens), F.array_join(tokens, " ").alias("__text"))

    def rows(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in _blocks(whole, len(keys)):
            owner, starts, h1, h2 = _hashed(b.column(len(keys)), n, True)
            split = [(t or "").split(" ") for t in b.column(len(keys) + 1).to_pylist()]
            grams = pa.array([" ".join(split[o][s : s + n]) for o, s in zip(owner.tolist(), starts.tolist())], pa.string())
            own = [b.column(i).take(pa.array(owner)) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), grams], names=[*keys, "h1", "h2", "ngram"])

    return _map(hashed, rows, ", ".join([*_columns(df, keys), "h1 long, h2 long, ngram string"]))


def ngram_hash_counts(df: DataFrame, tokens: Column, n: int, buckets: int, distinct: bool = False, more_than: int = 0) -> DataFrame:
    """``(h1, h2, n)``: 128 hash bits of each n-gram found more than ``more_than`` times, and how often it was found (with
    ``distinct``, in how many rows). If ``df`` has a long column ``mark``, the least mark of the rows that have it follows.

    Hashes are dealt by their first bits: those of a few texts that go
    to one bucket travel together as one row of bytes, and are sorted and counted where they arrive.
    """

    marks = [F.coalesce("mark", F.lit(0).cast("long")).alias("mark")] if "mark" in df.columns else []
    marked = bool(marks)
    names, width = ["h1", "h2", "n", "mark"][: 3 + len(marks)], 2 + len(marks)

    def deal(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in _blocks(whole, 0):
            owner, _, h1, h2 = _hashed(b.column(0), n, distinct)
            order = np.argsort(h1)
            own = [c.to_numpy(zero_copy_only=False).view(np.uint64)[owner[order]] for c in b.columns[1:]]
            table = np.stack([h1[order], h2[order], *own], axis=1)
            for lo in range(0, len(table), BLOCK):
                part = table[lo : lo + BLOCK]
                bucket = ((part[:, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))), len(part))
                packed = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8 * width).astype(np.int32)), pa.py_buffer(part.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int64)), packed], names=["bucket", "hashes"])

    def settled(parts: list[np.ndarray]) -> np.ndarray:
        """Rows (h1, h2, n, mark), one for each pair of hashes."""
        a = np.concatenate(parts)
        a = a[np.lexsort((a[:, 1], a[:, 0]))]
        at = np.flatnonzero(np.append(True, (a[1:, 0] != a[:-1, 0]) | (a[1:, 1] != a[:-1, 1])))
        least = [np.minimum.reduceat(a[:, 3].view(np.int64), at).view(np.uint64)] if marked else []
        return np.stack([a[at, 0], a[at, 1], np.add.reduceat(a[:, 2], at), *least], axis=1)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held, room = 0, 1 << 20
        for b in batches:
            for row in b.column(1):
                x = np.frombuffer(row.as_buffer(), np.uint64).reshape(-1, width)
                parts.append(np.insert(x, 2, 1, axis=1))
                held += len(x)
                if held > room:  # what is held does not grow with the copies of an n-gram
                    parts = [settled(parts)]
                    held = len(parts[0])
                    room = 2 * held + (1 << 20)
        if parts:
            a = settled(parts)
            a = a[a[:, 2] > more_than].view(np.int64)
            for lo in range(0, len(a), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[lo : lo + BATCH, i])) for i in range(len(names))], names=names)

    dealt = _map(df.select(_word_hashes(tokens), *marks), deal, "bucket long, hashes binary")
    return dealt.repartition(buckets, "bucket").mapInArrow(count, ", ".join(f"{c} long" for c in names))


def frequent_word_rows(df: DataFrame, key: str, text: Column, k: int) -> DataFrame:
    """``(key, word, n, rank)``: the ``k`` most frequent words of each row, in code point order on ties. Words are what
    Unicode whitespace parts."""

    def rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = b.column(1)
        for lo in range(0, len(texts), BATCH // k + 1):
            part = texts.slice(lo, BATCH // k + 1)
            top = [heapq.nsmallest(k, ((-c, w) for w, c in Counter((t or "").split()).items())) for t in part.to_pylist()]
            at = pa.array(np.repeat(np.arange(lo, lo + len(part)), [len(x) for x in top]))
            flat = [y for x in top for y in x]
            rank = [i + 1 for x in top for i in range(len(x))]
            cols = [b.column(0).take(at), pa.array([w for _, w in flat], pa.string()), pa.array([-c for c, _ in flat], pa.int64()), pa.array(rank, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "word", "n", "rank"])

    return _map(df.select(key, text.alias("__text")), rows, ", ".join([*_columns(df, [key]), "word string", "n long", "rank int"]))
