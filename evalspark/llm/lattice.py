"""Subword lattice likelihood: all segmentations of a word into vocabulary pieces, summed by log-space recursion."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import blocks, cut_lineage, hash_words

#: Most frequent training words whose scores are sent to all workers (24 bytes each); the others are joined.
FREQUENT = 1 << 17
LN10 = math.log(10)
_BATCH = 1 << 18


class Pieces:
    """Pieces of a public vocabulary as byte strings, in a trie of arrays, with the weights their scores imply.

    The model file ranks pieces: its scores are 0, −1, −2, …; a piece of rank r starts with a weight of 1 / (r + 10).
    Pieces that hold capital letters or a space past their first byte cannot occur in lower-cased words and are left
    out. Every byte has a fallback piece, so every word has a segmentation.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                name = model.id_to_piece(i).replace("▁", " ").encode()
                if name.lower() == name and b" " not in name[1:]:
                    names[name] = 1 / (10 - model.get_score(i))
        self.names = list(names)
        self.fallback = len(self.names)
        weight = np.array([*names.values(), *[1e-5] * 256])
        self.start = np.log(weight / weight.sum())
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k, name in enumerate(self.names):
            node = 0
            for byte in name:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][byte]
            ends[node] = k
        self.kind = np.zeros(256, np.int64)
        used = sorted({b for c in children for b in c})
        self.kind[used] = np.arange(1, len(used) + 1)
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        for node, c in enumerate(children):
            for byte, child in c.items():
                self.next[node, self.kind[byte]] = child
        self.end = np.array(ends)

    def edges(self, x: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of all lattice edges over bytes ``x``; ``stop`` is the end of the word of each byte."""
        at, node, size = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        first, last, piece = [at], [at + 1], [self.fallback + x.astype(np.int64)]
        kind = self.kind[x]
        while len(at):
            node = self.next[node, kind[at + size]]
            size += 1
            live = node > 0
            at, node = at[live], node[live]
            found = self.end[node]
            hit = found >= 0
            first.append(at[hit])
            last.append(at[hit] + size)
            piece.append(found[hit])
            more = at + size < stop[at]
            at, node = at[more], node[more]
        return np.concatenate(first), np.concatenate(last), np.concatenate(piece)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _by_step(key: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of edges by step and node, start of each node's edges, start of each step's nodes)."""
    order = np.lexsort((key, step))
    k, s = key[order], step[order]
    group = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
    return order, group, np.flatnonzero(np.append(True, s[group][1:] != s[group][:-1]))


def _log_sums(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(value, begin)
    return top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(begin, append=len(value)))), begin))


def _sweep(source: np.ndarray, target: np.ndarray, step: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    """Log-space recursion over a lattice: out[target] = log Σ exp(out[source] + weight), step by step."""
    order, group, steps = _by_step(target, step)
    source, target, weight = source[order], target[order], weight[order]
    ends = np.append(group[steps[1:]], len(order))
    for a, b, lo, hi in zip(group[steps], ends, steps, np.append(steps[1:], len(group)), strict=True):
        out[target[group[lo:hi]]] = _log_sums(out[source[a:b]] + weight[a:b], group[lo:hi] - a)


def forward(vocabulary: Pieces, logp: np.ndarray, words: list[bytes], expected: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the marginal probability of each word, with the space before it, over all its segmentations.

    With ``expected``, the expected number of uses of each piece, each word counted once or ``times``, is added to it
    (the backward recursion). Words of any length are summed without underflow.
    """
    out = np.zeros(len(words))
    for lo, hi in blocks(words, _BATCH):
        own = words[lo:hi]
        text = b" " + b" ".join(own)
        x = np.frombuffer(text, dtype=np.uint8)
        size = np.array([len(w) + 1 for w in own])
        begin = np.cumsum(size) - size
        # nodes: one for each byte, and one more at the end of each word
        number = np.repeat(np.arange(len(own)), size)
        first, last, piece = vocabulary.edges(x, np.repeat(begin + size, size))
        word = number[first]
        a, b, weight = first + word, last + word, logp[piece]
        start, end = begin + np.arange(len(own)), begin + size + np.arange(len(own))
        alpha = np.full(len(x) + len(own), -np.inf)
        alpha[start] = 0.0
        _sweep(a, b, last - begin[word], weight, alpha)
        out[lo:hi] = alpha[end]
        if expected is not None:
            beta = np.full(len(alpha), -np.inf)
            beta[end] = 0.0
            _sweep(b, a, (begin + size)[word] - first, weight, beta)
            uses = np.exp(alpha[a] + weight + beta[b] - out[lo:hi][word])
            expected += np.bincount(piece, weights=uses if times is None else uses * times[lo:hi][word], minlength=len(expected))
    return out


# --- counts, weights, scores -----------------------------------------------------------------------


def _taken(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary array of the slices, without a Python object for each."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    where = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x[where].tobytes())])


def _grouped(texts: list[bytes]) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: lower-cased bytes, position of the first text, its words' hashes, starts, sizes and texts."""
    for lo, hi in blocks(texts, 1 << 21):
        joined = b" ".join(texts[lo:hi]).lower()
        h, starts, sizes = hash_words(joined)
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[lo:hi]]), starts, side="right")
        yield joined, lo, h.view(np.int64), starts, sizes, owner


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, word, c): every distinct lower-cased word of all ``text`` values, its 64-bit hash and number of tokens."""
    schema = pa.schema([("h", pa.int64()), ("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for joined, _, h, starts, sizes, _ in _grouped([(t or "").encode() for t in b["text"].to_pylist()]):
                if len(h):
                    own, first, n = np.unique(h, return_index=True, return_counts=True)
                    word = _taken(np.frombuffer(joined, dtype=np.uint8), starts[first], sizes[first])
                    yield pa.RecordBatch.from_arrays([pa.array(own), word, pa.array(n)], schema=schema)

    counted = texts.select("text").mapInArrow(run, "h long, word binary, c long")
    return counted.groupBy("h", "word").agg(F.sum("c").alias("c"))


def piece_weights(counts: DataFrame, path: str, rounds: int = 4, prior: float = 0.01) -> np.ndarray:
    """Log probabilities of the pieces, from the vocabulary's own scores and ``rounds`` of expectation over all training
    tokens (each distinct word once, with its count). Workers send a number for each piece of the vocabulary; words
    stay where they are."""
    vocabulary = pieces(path)
    logp = vocabulary.start
    for _ in range(rounds):
        sent = counts.sparkSession.sparkContext.broadcast(logp)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, total = pieces(path), np.zeros(len(sent.value))
            for b in batches:
                forward(own, sent.value, b["word"].to_pylist(), total, b["c"].to_numpy())
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        uses = counts.select("word", "c").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        total = np.full(len(logp), prior)
        for r in uses:
            total[r["piece"]] += r["uses"]
        logp = np.log(total / total.sum())
    return logp


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the most frequent words: those whose count is in the highest classes that hold no more.

    There are 32 classes for each doubling of the count, some thousand in all, so that nothing is sorted and no task
    sees more than its own words.
    """
    level = F.floor(F.log2("c") * 32)
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    held, least = 0, None
    for at, n in sizes:
        if held + n > most:
            break
        held, least = held + n, at
    return counts.where(level >= least) if least is not None else counts.limit(0)


class Scorer:
    """Log probabilities of a token. ``alone``: the end of a text by its share of tokens, any other word by its lattice.
    ``model``: max(c − d, 0) / N + d·V / N · P(lattice), absolute discounting of word counts, whose discounted mass goes
    to spelled words. Both are distributions over all words and the end."""

    def __init__(self, tokens: int, kinds: int, once: int, twice: int, ends: int):
        self.n, self.v, self.ends = tokens, kinds, ends
        self.d = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def model(self, c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 of the probability of words with count ``c`` and natural log lattice probability ``lattice``."""
        if not self.n:
            return math.log10(0.5) + lattice / LN10
        spelled = lattice + math.log(self.d * self.v / self.n)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(c - self.d, 0) / self.n), spelled) / LN10

    def alone(self, lattice: np.ndarray) -> np.ndarray:
        return lattice / LN10 + self.inner()

    def inner(self) -> float:
        """log10 of the probability that a text goes on."""
        return math.log10((self.n - self.ends) / self.n) if self.n > self.ends else math.log10(0.5)

    def last(self) -> float:
        return math.log10(self.ends / self.n) if self.n > self.ends else math.log10(0.5)

    def end(self) -> float:
        return math.log10((self.ends - self.d) / self.n) if self.n else math.log10(0.5)


def score_texts(df: DataFrame, learn: F.Column, path: str, rounds: int = 4) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score, score and mixture_score of every whole ``text``, with doc_id and
    held_out. ``score`` is the marginal over all segmentations of each word; ``mixture_score`` mixes it with word counts.

    ``df`` has doc_id, text and held_out; the model learns from the rows where ``learn`` holds. A null text is empty:
    its one token is the end. Repeated rows are scored once and given back as often as they occur.

    Word counts of all training texts are aggregated by word. At most ``FREQUENT`` frequent words are sent to the
    workers with their scores; every other word of a text leaves its hash and lattice probability, which are joined
    with the counts and summed by text. So nothing that grows with the corpus is broadcast, and a very common word is
    never a join key.
    """
    counts = cut_lineage(word_counts(df.where(learn)))
    ends = df.where(learn).count()
    total, kinds, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    scorer = Scorer(total + ends, kinds + (ends > 0), once, twice, ends)
    logp = piece_weights(counts, path, rounds)
    top = frequent_words(counts, FREQUENT).select("h", "word", "c").toArrow()
    h = top["h"].to_numpy()
    order = np.argsort(h)
    c = top["c"].to_numpy()[order]
    lattice = forward(pieces(path), logp, top["word"].to_pylist())[order]
    sent = df.sparkSession.sparkContext.broadcast((h[order], scorer.base(c), scorer.alone(lattice), scorer.model(c, lattice), logp))
    schema = "doc_id long, text_key long, held_out boolean, h long, n long, lattice double, rows long, tokens long, known long, base double, alone double, model double"
    end_known, ended = int(ends > 0), (float(scorer.base(np.array([ends]))[0]), scorer.last(), scorer.end())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, *scores, logp_ = sent.value
        for b in batches:
            keys = [np.asarray(b[x].to_numpy(zero_copy_only=False)) for x in ("text_key", "held_out")]
            ids = b["doc_id"]
            for joined, lo, h, starts, sizes, owner in _grouped([(t or "").encode() for t in b["text"].to_pylist()]):
                order = np.lexsort((h, owner))
                hs, os = h[order], owner[order]
                first = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (os[1:] != os[:-1]))) if len(hs) else np.zeros(0, np.int64)
                n = np.diff(first, append=len(hs))
                hs, os, at = hs[first], os[first], order[first]
                place = np.minimum(np.searchsorted(common, hs), max(len(common) - 1, 0))
                hit = common[place] == hs if len(common) else np.zeros(len(hs), bool)
                rare_h, one, back = np.unique(hs[~hit], return_index=True, return_inverse=True)
                spot = at[~hit][one]
                spelled = forward(pieces(path), logp_, _taken(np.frombuffer(joined, dtype=np.uint8), starts[spot], sizes[spot]).to_pylist()) if len(rare_h) else np.zeros(0)
                yield from _rows(names, ids, keys, lo, os, hs, n, hit, place, scores, spelled[back.reshape(-1)] if len(spelled) else spelled)
            yield _ends(names, ids, keys, end_known, ended)

    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "held_out", "text")
    parts = keyed.mapInArrow(run, schema)
    parts = cut_lineage(parts)
    key = ["doc_id", "text_key", "held_out"]
    done = parts.where("h is null").select(*key, "rows", "tokens", "known", "base", "alone", "model")
    rare = parts.where("h is not null").join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    base = F.log10((F.col("c") + 0.5) / F.lit(scorer.n + 0.5 * (scorer.v + 1)))
    share = scorer.d * scorer.v / scorer.n if scorer.n else 0.5
    # log10(x + share · e^lattice), from the larger term so that nothing underflows
    word = F.greatest(F.col("c") - F.lit(scorer.d), F.lit(0.0)) / F.lit(float(max(scorer.n, 1)))
    low = F.col("lattice") / LN10 + math.log10(share)
    model = F.when(word > 0, F.log10(word) + F.log1p(F.pow(F.lit(10.0), F.least(low - F.log10(word), F.lit(300.0)))) / LN10).otherwise(low)
    own = rare.select(*key, F.lit(0).cast("long").alias("rows"), F.col("n").alias("tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)).cast("long").alias("known"), (F.col("n") * base).alias("base"), (F.col("n") * (F.col("lattice") / LN10 + scorer.inner())).alias("alone"), (F.col("n") * model).alias("model"))
    summed = done.unionByName(own).groupBy(*key).agg(*[F.sum(x).alias(x) for x in ("rows", "tokens", "known", "base", "alone", "model")])
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    per = lambda x: (F.col(x) / F.col("rows"))
    return summed.withColumn("__i", times).select(
        "doc_id",
        "held_out",
        per("tokens").cast("long").alias("n_tokens"),
        per("known").cast("long").alias("n_known"),
        F.lit(scorer.n).cast("long").alias("train_tokens"),
        per("base").alias("base_score"),
        per("alone").alias("score"),
        per("model").alias("mixture_score"),
    )


def _rows(names, ids, keys, lo, owner, h, n, hit, place, scores, spelled) -> Iterator[pa.RecordBatch]:
    """Sums over the frequent words of each text, and a row for each of its other words."""
    if not len(h):
        return
    size = int(owner.max()) + 1
    sums = [np.bincount(owner[hit], weights=w, minlength=size) for w in (n[hit], *[n[hit] * s[place[hit]] for s in scores])]
    which = np.flatnonzero(sums[0])
    sums = [x[which] for x in sums]
    far = np.flatnonzero(~hit)
    text = np.concatenate([which, owner[far]]) + lo
    k, f = len(which), len(far)
    blank = lambda real, back: pa.array(np.concatenate(real), mask=np.repeat(back, (k, f)))
    zero = np.zeros(f)
    tokens = np.concatenate([sums[0], zero]).astype(np.int64)
    cols = {
        "doc_id": ids.take(pa.array(text)),
        "text_key": pa.array(keys[0][text]),
        "held_out": pa.array(keys[1][text].astype(bool)),
        "h": blank([np.zeros(k, np.int64), h[far]], [True, False]),
        "n": pa.array(np.concatenate([np.zeros(k, np.int64), n[far]])),
        "lattice": pa.array(np.concatenate([np.zeros(k), spelled])),
        "rows": pa.array(np.zeros(k + f, np.int64)),
        "tokens": pa.array(tokens),
        "known": pa.array(tokens),
        **{name: pa.array(np.concatenate([own, zero])) for name, own in zip(("base", "alone", "model"), sums[1:], strict=True)},
    }
    yield pa.RecordBatch.from_arrays([cols[x] for x in names], names=names)


def _ends(names, ids, keys, known, scores) -> pa.RecordBatch:
    """The end of each text, as a row of its own that also counts the text's rows."""
    n = len(ids)
    one = np.ones(n, np.int64)
    cols = {
        "doc_id": ids,
        "text_key": pa.array(keys[0]),
        "held_out": pa.array(keys[1].astype(bool)),
        "h": pa.array(one, mask=np.ones(n, bool)),
        "n": pa.array(0 * one),
        "lattice": pa.array(np.zeros(n)),
        "rows": pa.array(one),
        "tokens": pa.array(one),
        "known": pa.array(known * one),
        **{name: pa.array(np.full(n, own)) for name, own in zip(("base", "alone", "model"), scores, strict=True)},
    }
    return pa.RecordBatch.from_arrays([cols[x] for x in names], names=names)
