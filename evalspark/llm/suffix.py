"""Suffix-array dedup: pieces that share an anchor meet in shards, whose suffix arrays are built by induced sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import arrow_pass, blocks, cut_lineage, hash_words, mix, with_filter
from evalspark.session import broadcast_if_small

LENGTH, GRAM = 400, 64
#: A passage of just over 50 words is a repeat, however few bytes it has.
PASSAGE_WORDS = 51
#: Words whose hash is an anchor where strings are counted in words.
WORD_GRAM = 8
SMALL = 200_000
SHARD_BYTES, HOT_BYTES = 1 << 20, 8 << 20
_CHUNK = 1 << 22
#: Bytes of short texts that are read together.
_BLOCK = 1 << 17
_LOW = np.uint64(0xFFFFFF)
_ODD = np.random.default_rng(41).integers(1, 2**63, GRAM // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Columns of a piece, 8 bytes each: its place (see _place), its anchor and its digest. Anchor and digest tell pieces apart.
PIECE = ("place", "anchor", "digest")
#: Parts of the distance between a string's start and its anchor, see _candidates.
_PARTS = 8
#: Separates pieces in a shard; no byte of UTF-8 text has this value.
_GAP = 0xFF


# --- suffix arrays ---------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (type S); the last one, the sentinel, is."""
    rise = np.append(np.sign(np.diff(t.astype(np.int64))), 1)
    at = np.where(rise != 0, np.arange(len(t)), len(t) - 1)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """Suffix order induced from leftmost-smaller suffixes ``lms`` in the order given within each bucket.

    Buckets are walked in order; the members of one bucket that are ready induce theirs all at once. A bucket that
    induces into itself (a run of one symbol) is walked again until nothing new comes.
    """
    n = len(t)
    sizes = np.bincount(t, minlength=k)
    end = np.cumsum(sizes)
    start = end - sizes
    sa = np.full(n, -1, np.int64)
    order = np.argsort(t[lms], kind="stable")
    seeds = lms[order]
    seeded = np.bincount(t[lms], minlength=k)
    sa[(end - seeded)[t[seeds]] + np.arange(len(seeds)) - (np.cumsum(seeded) - seeded)[t[seeds]]] = seeds
    head = start.copy()

    def put(cur: np.ndarray, at: np.ndarray, kind: bool) -> None:
        pred = cur[cur > 0] - 1
        pred = pred[small[pred] == kind]
        if len(pred):
            symbol = t[pred]
            o = np.argsort(symbol, kind="stable")
            symbol, pred = symbol[o], pred[o]
            count = np.bincount(symbol, minlength=k)
            rank = np.arange(len(pred)) - (np.cumsum(count) - count)[symbol]
            if kind:
                sa[at[symbol] - 1 - rank] = pred
                at -= count
            else:
                sa[at[symbol] + rank] = pred
                at += count

    used = np.flatnonzero(sizes)
    for c in used:
        p = start[c]
        while p < head[c]:
            q = head[c]
            put(sa[p:q], head, False)
            p = q
        put(sa[end[c] - seeded[c] : end[c]], head, False)
    tail = end.copy()
    for c in used[:0:-1]:
        q = end[c]
        while tail[c] < q:
            p = tail[c]
            put(sa[p:q][::-1], tail, True)
            q = p
        put(sa[start[c] : head[c]][::-1], tail, True)
    sa[0] = n - 1
    return sa


def _induce_list(t: list[int], small: list[bool], lms: list[int], k: int) -> list[int]:
    """The same for large alphabets, one suffix at a time."""
    n = len(t)
    sizes = [0] * k
    for c in t:
        sizes[c] += 1
    start, total = [0] * k, 0
    for c in range(k):
        start[c] = total
        total += sizes[c]
    end = [a + b for a, b in zip(start, sizes, strict=True)]
    sa = [-1] * n
    tail = end[:]
    for i in reversed(lms):
        tail[t[i]] -= 1
        sa[tail[t[i]]] = i
    for j in sa:  # what is put further on is met later in this same walk
        if j > 0 and not small[j - 1]:
            j -= 1
            c = t[j]
            h = start[c]
            sa[h] = j
            start[c] = h + 1
    for j in reversed(sa):
        if j > 0 and small[j - 1]:
            j -= 1
            c = t[j]
            h = end[c] - 1
            sa[h] = j
            end[c] = h
    sa[0] = n - 1
    return sa


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of ``t`` by induced sorting; values are below ``k`` and the last is the one 0.

    Suffixes are classified; leftmost-smaller substrings are sorted by inducing from their first symbols, named, and
    the string of names is sorted by the same function; a last pass induces the whole array from their order.
    """
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    if k <= 1 << 16:
        t = t.astype(np.uint16)  # sorted by radix
    small = _types(t)
    lms = np.flatnonzero(small & ~np.append(True, small[:-1]))
    wide = 64 * k > n
    if wide:
        tl, sl = t.tolist(), small.tolist()
        induce = lambda order: np.array(_induce_list(tl, sl, order.tolist(), k))
    else:
        induce = lambda order: _induce(t, small, order, k)
    sa = induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    size = np.diff(lms, append=n) + 1  # up to and with the next one's first symbol
    length = np.zeros(n, np.int64)
    length[lms] = np.minimum(size, n - lms)
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    a, b, own = a[same], b[same], length[ordered[:-1][same]]
    if len(a):
        begin = np.cumsum(own) - own
        step = np.arange(own.sum()) - np.repeat(begin, own)
        same[same] = np.logical_and.reduceat(t[np.repeat(a, own) + step] == t[np.repeat(b, own) + step], begin)
    names = np.append(0, np.cumsum(~same))
    kinds = int(names[-1]) + 1
    if kinds < len(lms):
        name_at = np.zeros(n, np.int64)
        name_at[ordered] = names
        ordered = lms[suffix_array(name_at[lms], kinds)]
    return induce(ordered)


def permuted_lcp(raw: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix of each suffix with the one before it in ``sa``, that one), both in text order.

    Where the preceding symbols agree, the value is that of the position before, less one; only the other positions
    are compared, eight bytes at a time, all at once. ``raw`` has no sentinel; ``sa`` is of the text with one.
    """
    n = len(raw)
    phi = np.full(n + 1, n)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([raw, np.frombuffer(b"\xfe" + b"\xfd" * 15, dtype=np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    here, there = np.arange(n), phi[:n]
    before = np.where((here > 0) & (there > 0), padded[here - 1] == padded[there - 1], False)
    start = np.flatnonzero(~before)
    lcp = np.zeros(n, np.int64)
    i, j, off = start, there[start], 0
    alive = np.arange(len(start))
    found = np.zeros(len(start), np.int64)
    while len(alive):
        far = np.maximum(i[alive], j[alive]) + off
        ok = far < n
        alive = alive[ok]
        x = words[i[alive] + off] ^ words[j[alive] + off]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        found[alive[differ]] = off + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[~differ]
        off += 8
        found[alive] = off
    room = n - np.maximum(i, j)
    lcp[start] = np.minimum(found, room)
    last = np.maximum.accumulate(np.where(before, 0, np.arange(n)))
    return lcp[last] - (np.arange(n) - last), phi[:n]


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, whether the string of ``length`` bytes at each of its possible starts is elsewhere in the pieces."""
    raw = np.frombuffer(b"\xff".join(pieces), dtype=np.uint8)
    sa = suffix_array(np.append(raw.astype(np.int64) + 1, 0), 257)
    lcp, phi = permuted_lcp(raw, sa)
    hit = np.zeros(len(raw) + 1, bool)
    far = lcp >= length
    hit[:-1] |= far
    hit[phi[far]] = True
    out, at = [], 0
    for p in pieces:
        out.append(hit[at : at + len(p) - length + 1])
        at += len(p) + 1
    return out


# --- pieces ----------------------------------------------------------------------------------------


def pieces_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, size, where the anchor is in the piece, anchor) of pieces of texts, such that each string of
    ``length`` bytes lies whole in one piece and equal strings lie in pieces with one anchor, wherever they are.

    The anchor of a string is its ``gram`` bytes with the least hash, the first of equals; strings next to each other
    with the same anchor make up a piece. Short texts are read together.
    """
    out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
    width = length - gram + 1
    for lo, hi in blocks(texts, _BLOCK):
        joined = b"".join(texts[lo:hi])
        end = np.cumsum([len(t) for t in texts[lo:hi]])
        begin = np.append(0, end[:-1])
        for at in range(0, len(joined) - length + 1, _CHUNK):
            part = joined[at : at + _CHUNK + length - 1]
            n = len(part) - gram + 1
            words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
            h = np.zeros(n, np.uint64)
            for j, odd in enumerate(_ODD[: gram // 8]):
                h += words[8 * j : 8 * j + n] * odd
                h ^= h >> np.uint64(29)
            h = mix(h)
            least = _least(h, width)
            first, many, own = _runs(least, begin - at, end - at, length)
            out.append((own + lo, first + at - begin[own], many + length - 1, least[first] - first, h[least[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(least: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, number, text) of runs of windows with one place in ``least``, of those that lie in one text."""
    cuts = np.concatenate([np.flatnonzero(np.diff(least, prepend=-1)), begin, end - length + 1])
    cuts = np.unique(cuts[(cuts >= 0) & (cuts < len(least))])
    own = np.searchsorted(end, cuts, side="right")
    whole = cuts + length <= end[own]
    return cuts[whole], np.diff(cuts, append=len(least))[whole], own[whole]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` hashes in a row, the first of equals; below 2^24 hashes."""
    n = len(h)
    rows = -(-n // width)
    full = np.full(rows * width, 2**64 - 1, np.uint64)
    full[:n] = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    block = full.reshape(rows, width)
    prefix = np.minimum.accumulate(block, axis=1).ravel()
    suffix = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(suffix[:m], prefix[width - 1 : width - 1 + m]) & _LOW).astype(np.int64)


def word_pieces_of(texts: list[bytes], words: int, gram: int = WORD_GRAM) -> tuple[np.ndarray, ...]:
    """The same for strings of ``words`` words: (text, first byte, size in bytes, -1, anchor) of pieces that begin and
    end with a word. The anchor is the least hash of ``gram`` words in a row, so space between words has no part in it."""
    out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
    gram = min(gram, words)
    for lo, hi in blocks(texts, _BLOCK):
        h, first_byte, size = hash_words(b" ".join(texts[lo:hi]))
        begin_byte = np.cumsum([0, *[len(t) + 1 for t in texts[lo:hi]]])
        begin = np.searchsorted(first_byte, begin_byte)
        grams = np.zeros(max(len(h) - gram + 1, 0), np.uint64)
        for j in range(gram):
            grams = mix(grams + h[j : j + len(grams)])
        end_byte = first_byte + size
        for at in range(0, len(h) - words + 1, _CHUNK):
            part = grams[at : at + _CHUNK + words - gram]
            least = _least(part, words - gram + 1)
            first, many, own = _runs(least, begin[:-1] - at, begin[1:] - at, words)
            start = first_byte[first + at]
            out.append((own + lo, start - begin_byte[own], end_byte[first + many + at + words - 2] - start, np.full(len(first), -1), part[least[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_strings(pieces: list[bytes], words: int) -> dict[str, np.ndarray]:
    """Strings of ``words`` words in the pieces: piece, number of the first word, byte range and 128-bit hash (w1, w2)."""
    h, start, size = hash_words(b" ".join(pieces))
    begin = np.cumsum([0, *[len(p) + 1 for p in pieces]])
    owner = np.searchsorted(begin, start, side="right") - 1
    m = max(len(h) - words + 1, 0)
    out = {}
    for name, x, odd in zip(("w1", "w2"), (h, mix(h + _ODD[0])), _ODD[1:], strict=False):
        # strings of 1, 2, 4 ... words, of which those in the binary digits of ``words`` follow each other
        w, done, step = np.zeros(m, np.uint64), 0, 1
        while True:
            if words & step:
                w = mix(w * odd + x[done : done + m])
                done += step
            if 2 * step > words:
                break
            x = mix(x[:-step] * odd + x[step:])
            step *= 2
        out[name] = w.view(np.int64)
    whole = np.flatnonzero(owner[:m] == owner[len(h) - m :])
    last = whole + words - 1
    base = begin[owner[whole]]
    return {k: v[whole] for k, v in out.items()} | {"piece": owner[whole], "i": whole, "a": start[whole] - base, "b": start[last] + size[last] - base}


def _keys(text: str) -> tuple[F.Column, F.Column]:
    """Two independent 64-bit hashes of a text, in place of the text; null is empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(value), F.xxhash64(F.lit(7), value)


def piece_table(df: DataFrame, text: str = "text", length: int = LENGTH, words: int = 0) -> DataFrame:
    """(doc_id, k1, k2) of each row, hashes of its text, and its pieces as arrays: place, anchor and digest.

    One reading of a text gives its pieces for strings of ``length`` bytes and, with a negative place, for strings of
    ``words`` words; 0 leaves a kind out. Digests and anchors of the two kinds are apart.
    """
    ways = [lambda texts: pieces_of(texts, length)] * (length > 0) + [lambda texts: word_pieces_of(texts, words)] * (words > 0)

    def run(cols: dict) -> dict:
        texts = [(t or "").encode() for t in cols["text"]]
        own, start, size, at, anchor = (np.concatenate(x) for x in zip(*[way(texts) for way in ways], strict=True))
        order = np.argsort(own, kind="stable")
        own, start, size, at, anchor = (x[order] for x in (own, start, size, at, anchor))
        digest = lambda t, a, n, w: hashlib.blake2b(memoryview(texts[t])[a : a + n], digest_size=8, key=b"w" * w).digest()
        d = np.frombuffer(b"".join(map(digest, own.tolist(), start.tolist(), size.tolist(), (at < 0).tolist())), dtype="<i8")
        place = start << 32 | size
        flat = (np.where(at < 0, ~place, place), np.where(at < 0, mix(anchor), anchor).view(np.int64), d)
        ends = pa.array(np.searchsorted(own, np.arange(len(texts) + 1)), pa.int32())
        return {c: cols[c] for c in ("doc_id", "k1", "k2")} | {c: pa.ListArray.from_arrays(ends, pa.array(x)) for c, x in zip(PIECE, flat, strict=True)}

    k1, k2 = _keys(text)
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    return arrow_pass(own, run, "doc_id long, k1 long, k2 long, " + ", ".join(f"{c} array<long>" for c in PIECE))


def _place(place: str) -> tuple[F.Column, F.Column, F.Column]:
    """(start, size, whether it is in words) of a piece: the start in the upper and the size in the lower 32 bits, all
    inverted for strings of words."""
    value = F.when(F.col(place) < 0, F.bitwise_not(F.col(place))).otherwise(F.col(place))
    return F.shiftright(value, 32), value.bitwiseAND(F.lit(0xFFFFFFFF)), F.col(place) < 0


def repeated_spans(df: DataFrame, text: str = "text", length: int = LENGTH, hot_bytes: int = HOT_BYTES, shard_bytes: int = SHARD_BYTES, words: int = 0) -> DataFrame:
    """(k1, k2, spans): for each text with repeats, byte ranges (a, b, w) to remove, which may touch or overlap.

    A byte goes if it lies in a string of ``length`` bytes that starts anywhere else as well, in the same text or in
    any other. Copies of a piece are counted before the shuffle and stand as one piece with a count; a piece seen
    twice is repeated from end to end. Anchors with more than one different piece go to shards of about
    ``shard_bytes``, whose suffix arrays and permuted common prefixes decide each start. An anchor whose different
    pieces exceed ``hot_bytes`` (one passage in very many different surroundings) is not sorted in one task: its
    strings are counted by 128-bit hash instead, spread over all tasks, with the same result.

    With ``words``, strings of that many words are found as well, whatever space is between them, and their ranges are
    marked ``w``; in a shard they are counted by 128-bit hash. A ``length`` of 0 leaves strings of bytes out.
    """
    table = cut_lineage(piece_table(df, text, length, words))
    occ = table.select("k1", "k2", F.inline(F.arrays_zip(*PIECE)))
    anchors = occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    anchors = cut_lineage(anchors.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")))
    seen = cut_lineage(occ.join(anchors, "anchor"))
    kinds = seen.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("mixed").alias("mixed"), F.min(F.struct("k1", "k2", "place")).alias("rep"))
    start, size, in_words = _place("rep.place")
    kinds = cut_lineage(kinds.select("anchor", "digest", "n", "mixed", "rep.k1", "rep.k2", start.alias("start"), size.alias("size"), in_words.alias("w")))
    whole = kinds.where("n > 1").select("anchor", "digest", F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))
    asked = kinds.where("mixed").withColumn("many", F.col("n") > 1)
    weight = asked.groupBy("anchor").agg(F.sum("size").alias("bytes"))
    total = weight.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    hot = weight.where(F.col("bytes") > hot_bytes).select("anchor", F.lit(True).alias("hot"))
    asked = asked.join(broadcast_if_small(hot, SMALL), "anchor", "left")
    ask = F.struct("start", "size", "w", "anchor", "digest", "many", F.coalesce("hot", F.lit(False)).alias("hot"), F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    # of equal texts the row with the least id shows the pieces
    first = table.groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(-1)).alias("id"))).alias("row"))
    wanted = asked.groupBy("k1", "k2").agg(F.collect_list(ask).alias("asks")).join(first, ["k1", "k2"])
    wanted = cut_lineage(wanted.select("row.nil", "row.id", "k1", "k2", "asks"))
    k1, k2 = _keys(text)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))
    docs = docs.select(F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(-1)).alias("id"), "k1", "k2", "text")
    shown = with_filter(docs, wanted, "k1").where("__maybe").join(wanted, ["nil", "id", "k1", "k2"]).select("text", "asks")

    def cut(cols: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("shard", "hot", "anchor", "digest", "many", "w", "piece")}
        for t, asks in zip(cols["text"], cols["asks"], strict=True):
            raw = t.encode()
            for a in asks:
                for c in ("shard", "hot", "anchor", "digest", "many", "w"):
                    out[c].append(a[c])
                out["piece"].append(raw[a["start"] : a["start"] + a["size"]])
        # a piece by itself is one piece again, so its anchor is found where it was
        out["at"] = np.full(len(out["w"]), -1)
        in_bytes = [i for i, w in enumerate(out["w"]) if not w]
        out["at"][in_bytes] = pieces_of([out["piece"][i] for i in in_bytes], length)[3] if in_bytes else []
        return out

    pieces = arrow_pass(shown, cut, "shard long, hot boolean, anchor long, digest long, many boolean, at int, piece binary")
    some_hot = hot.limit(1).count() > 0
    if some_hot:
        pieces = cut_lineage(pieces)
    sorted_in = pieces.where("not hot").repartition("shard").sortWithinPartitions("shard", "anchor", "digest")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, known, out = None, ({}, {}), set(), []
        ranges = lambda: _ranges(_candidates(held[0], length), known, lambda pieces: _byte_hits(pieces, length)) + _ranges(held[1], known, lambda pieces: _word_hits(pieces, words))
        for b in batches:
            for s, anchor, digest, many, at, piece in zip(*[b[c].to_pylist() for c in ("shard", "anchor", "digest", "many", "at", "piece")], strict=True):
                if s != shard:
                    out += ranges()
                    shard, held, known = s, ({}, {}), set()
                if at < 0:
                    held[1][anchor, digest] = piece
                else:
                    held[0][anchor, digest] = (anchor, at, piece)
                if many:
                    known.add((anchor, digest))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RANGE)
                out = []
        out += ranges()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RANGE)

    found = sorted_in.mapInArrow(search, "anchor long, digest long, a long, b long")
    if some_hot:
        for kind, size in ((False, length), (True, words)):
            if size:
                found = found.unionByName(_counted(pieces.where("hot").where((F.col("at") < 0) == kind), length, words * kind))
    # one row for a piece with all its ranges meets one row for a text with all places of that piece
    flagged = cut_lineage(whole.unionByName(found).groupBy("anchor", "digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))
    start, _, in_words = _place("place")
    places = seen.groupBy("k1", "k2", "anchor", "digest").agg(F.collect_set(start).alias("starts"), F.max(in_words).alias("w"))
    at = lambda s: F.transform("ranges", lambda r: F.struct((s + r["a"]).alias("a"), (s + r["b"]).alias("b"), F.col("w").alias("w")))
    spans = places.join(flagged, ["anchor", "digest"]).select("k1", "k2", F.flatten(F.transform("starts", at)).alias("spans"))
    return spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_RANGE = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _candidates(held: dict[tuple[int, int], tuple[int, int, bytes]], length: int, gram: int = GRAM) -> dict[tuple[int, int], bytes]:
    """The pieces of ``held`` (anchor, its place, bytes) that can have a string of ``length`` bytes in common.

    Equal strings have their anchor at the same place. Wherever a string starts before it, from ``k`` to ``k + 1`` parts
    of the greatest distance, it covers all bytes from ``k`` parts before the anchor up to what is left of its length
    after ``k + 1`` parts; so two pieces with the string have these bytes in common for some ``k``.
    """
    room = length - gram
    part = max(1, -(-room // _PARTS))
    first: dict[tuple, tuple[int, int]] = {}
    able = set()
    for name, (anchor, at, piece) in held.items():
        for before in range(0, room + 1, part):
            end = at + gram + max(0, room - before - part)
            if at < before or end > len(piece):
                continue
            other = first.setdefault((anchor, before, piece[at - before : end]), name)
            if other is not name:
                able |= {other, name}
    return {name: x[2] for name, x in held.items() if name in able}


def _ranges(held: dict[tuple[int, int], bytes], known: set, hits) -> list[dict]:
    """Byte ranges of the pieces of one shard that strings found elsewhere in the shard cover, as ``hits`` has them for
    each piece; pieces in ``known`` are repeated from end to end and give none."""
    if len(held) < 2 or held.keys() <= known:
        return []
    names = list(held)
    return [{"anchor": names[p][0], "digest": names[p][1], "a": a, "b": b} for p, a, b in hits(list(held.values())) if names[p] not in known]


def _byte_hits(pieces: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(piece, first byte, end) of runs of repeated strings of ``length`` bytes."""
    for p, hit in enumerate(repeated_starts(pieces, length)):
        edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            yield p, a, b - 1 + length


def _word_hits(pieces: list[bytes], words: int) -> Iterator[tuple[int, int, int]]:
    """The same for strings of ``words`` words; strings of one piece that start with words in a row make one run."""
    s = word_strings(pieces, words)
    order = np.lexsort((s["w2"], s["w1"]))
    same = (np.diff(s["w1"][order]) == 0) & (np.diff(s["w2"][order]) == 0)
    hit = np.sort(order[np.append(same, False) | np.append(False, same)])
    if len(hit):
        first = np.flatnonzero(np.append(True, (np.diff(s["i"][hit]) > 1) | (np.diff(s["piece"][hit]) > 0)))
        last = np.append(first[1:], len(hit)) - 1
        yield from zip(s["piece"][hit[first]].tolist(), s["a"][hit[first]].tolist(), s["b"][hit[last]].tolist(), strict=True)


def _counted(pieces: DataFrame, length: int, words: int = 0) -> DataFrame:
    """Ranges of the different pieces of hot anchors, from counts of their strings by 128-bit hash."""

    def strings(cols: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("w1", "w2", "anchor", "digest", "many", "a")}
        for anchor, digest, many, piece in {(a, b): (a, b, m, p) for a, b, m, p in zip(cols["anchor"], cols["digest"], cols["many"], cols["piece"], strict=True)}.values():
            for a in range(len(piece) - length + 1):
                w = hashlib.blake2b(piece[a : a + length], digest_size=16).digest()
                for c, v in zip(out, (int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True), anchor, digest, many, a), strict=True):
                    out[c].append(v)
        return out

    def in_words(cols: dict) -> dict:
        held = {(a, b): (m, p) for a, b, m, p in zip(cols["anchor"], cols["digest"], cols["many"], cols["piece"], strict=True)}
        s, names = word_strings([p for _, p in held.values()], words), np.array(list(held))
        return s | {"anchor": names[s["piece"], 0], "digest": names[s["piece"], 1], "many": np.array([m for m, _ in held.values()])[s["piece"]]}

    if words:
        every = arrow_pass(pieces.dropDuplicates(["anchor", "digest"]), in_words, "w1 long, w2 long, anchor long, digest long, many boolean, i long, a long, b long")
    else:
        every = arrow_pass(pieces.dropDuplicates(["anchor", "digest"]), strings, "w1 long, w2 long, anchor long, digest long, many boolean, a long")
    every = cut_lineage(every)
    twice = every.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = every.where("not many").join(twice, ["w1", "w2"])
    if words:
        run = F.col("i") - F.row_number().over(Window.partitionBy("anchor", "digest").orderBy("i"))
        return hits.withColumn("run", run).groupBy("anchor", "digest", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")
    hits = hits.select("anchor", "digest", "a").distinct()
    # starts in a row make one range
    run = F.col("a") - F.row_number().over(Window.partitionBy("anchor", "digest").orderBy("a"))
    return hits.withColumn("run", run).groupBy("anchor", "digest", "run").agg(F.min("a").alias("a"), (F.max("a") + length).alias("b")).drop("run")


def merged(spans: list[dict] | None, w: bool | None = None) -> list[tuple[int, int]]:
    """Maximal ranges of spans that touch or overlap; with ``w``, of one kind alone."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or [] if w is None or s["w"] == w):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(df: DataFrame, text: str = "text", **how) -> DataFrame:
    """``df`` with __spans, null where a text has no repeats. Only texts that a bit filter finds likely to have spans
    move for the join."""
    spans = repeated_spans(df, text, **how)
    spans = cut_lineage(spans.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "spans": "__spans"}))
    k1, k2 = _keys(text)
    keyed = with_filter(df.withColumn("__k1", k1).withColumn("__k2", k2), spans, "__k1")
    found = keyed.where("__maybe").join(spans, ["__k1", "__k2"], "left")
    rest = keyed.where("not __maybe").withColumn("__spans", F.lit(None).cast(spans.schema["__spans"].dataType))
    names = [*df.columns, "__spans"]
    return found.select(*names).unionByName(rest.select(*names))


def removal_digest(df: DataFrame, text: str = "text", **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left, for each row, of strings of ``length`` bytes.

    With ``words``, n_passages and n_passage_bytes follow: maximal runs of strings of that many words that start
    elsewhere too, since a passage of a little over 50 words can be shorter than ``length`` bytes.
    """

    def run(cols: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes")}
        for d, t, spans in zip(cols["doc_id"], cols["text"], cols["__spans"], strict=True):
            raw, left, at, gone = (t or "").encode(), hashlib.sha256(), 0, merged(spans, False)
            passages = merged(spans, True)
            for a, b in gone:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            for c, v in zip(out, (d, len(raw), sum(b - a for a, b in gone), len(gone), left.hexdigest(), len(passages), sum(b - a for a, b in passages)), strict=True):
                out[c].append(v)
        return out

    own = with_spans(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), "text", **how)
    out = arrow_pass(own, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long")
    return out if how.get("words") else out.drop("n_passages", "n_passage_bytes")


def without_repeats(df: DataFrame, text: str = "text", **how) -> DataFrame:
    """``df`` with the repeated bytes taken out of its texts; where a cut falls inside a character, the bytes left of
    it go too, so that texts stay valid. Null texts stay null."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(cols: dict) -> dict:
        texts = []
        for t, spans in zip(cols[text], cols["__spans"], strict=True):
            if t is not None and spans:
                raw, left, at = t.encode(), [], 0
                for a, b in merged(spans):
                    left.append(raw[at:a].decode(errors="ignore"))
                    at = b
                t = "".join([*left, raw[at:].decode(errors="ignore")])
            texts.append(t)
        return {c: cols[c] for c in names} | {text: texts}

    return arrow_pass(with_spans(df, text, **how), run, schema)
