"""Packing token ids into fixed windows: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import Memory, arrow_pass, blocks, cut_lineage, kept
from evalspark.operators.ordering import with_position

EOS = 1
#: Characters that count as white space in some libraries only; units with them are odd.
_ODD = frozenset("\x1c\x1d\x1e\x1f\x85\u180e\u200b\u2060\ufeff\0")
#: Units (words with the space before them) whose ids a worker remembers, at most.
REMEMBERED = 1_800_000


class UnitTokenizer:
    """Ids of whole texts from a byte-level BPE file, unit by unit.

    The vocabulary's own splitting rule never joins a character with a following single space or line feed that has
    visible text on both sides, so ids of the units between them, each with its space, make up the ids of the text.
    Units repeat; their ids are remembered. Texts with any other white space, or with the string of a special token,
    go through the tokenizer whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.first, self.spaced = Memory(remembered // 5), Memory(remembered)
        self.feed = self._whole("\n")
        self.stops = {c: self._whole(c) for c in ",."}  # a token of their own after a letter
        self.feed_id = int.from_bytes(self.feed, "little")

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _odd(self, word: str) -> bool:
        if word.isascii() and word.isalpha():
            return False
        return word.split() != [word] or any(s in word for s in self.special) or not _ODD.isdisjoint(word)

    def _learn(self, known: Memory, words: set[str], before: str) -> None:
        """Ids of new units. Many go through the tokenizer as one text, a line feed between them; their ids are those
        between the ids of line feeds."""
        known.make_room(2 * len(words))
        words = {w for w in words if w not in known and w not in known.old}
        ended = {w: w[:-1] for w in words if w[-1:] in self.stops and w[:-1].isalpha() and (w.isascii() or max(w) < "\u0250")}
        words |= set(ended.values())
        new = [w for w in words if w not in ended and w not in known and w not in known.old]
        known.update(dict.fromkeys(new))
        plain = [w for w in new if not self._odd(w)]
        for at in range(0, len(plain), 400):
            part = plain[at : at + 400]
            joined = "\n".join(before + w for w in part) + "\n"
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.feed_id) * 4
            raw = ids.tobytes()
            known.update(zip(part, (raw[i:j] for i, j in zip([0, *(ends[:-1] + 4)], ends, strict=True)), strict=True))
        known.update((w, known[core] + self.stops[w[-1]]) for w, core in ended.items())

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. About 2 MB of text are split at a time; what is new in
        them is learned at once."""
        out = []
        for lo, hi in blocks(texts, 1 << 21):
            split = [[line.split(" ") for line in t.split("\n")] for t in texts[lo:hi]]
            self._learn(self.first, {line[0] for t in split for line in t}, "")
            self._learn(self.spaced, set().union(*[line[1:] for t in split for line in t]), " ")
            for t, lines in zip(texts[lo:hi], split, strict=True):
                try:
                    out.append(self._joined(lines) if t else b"")
                except (TypeError, KeyError):  # an odd unit, or units forgotten just now
                    out.append(self._whole(t))
        return out

    def _joined(self, lines: list[list[str]]) -> bytes:
        parts: list = []
        first, spaced = self.first, self.spaced.__getitem__
        for words in lines:
            parts += (self.feed, first[words[0]])
            parts += map(spaced, words[1:])
        return b"".join(parts[1:])


def tokenizer(path: str, remembered: int = REMEMBERED) -> UnitTokenizer:
    """One tokenizer per worker process, until a pass without one runs there."""
    return kept(("tokenizer", path, remembered), lambda: UnitTokenizer(path, remembered))


def token_pieces(df: DataFrame, vocabulary: str, window: int = 2048, text: str = "text", keep_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of every text's ids, of ``window`` ids and a last shorter one: doc_id, start, length, ids_crc32,
    doc_tokens and, with ``keep_ids``, the ids themselves.

    The ids of a text are followed by the end id; so an empty or null text has one piece of one id, and no document
    is without a piece. Repeated rows give repeated pieces. Each worker remembers ids of at most ``remembered`` units,
    about 230 bytes each; with fewer it learns units again, with the same ids.
    """

    def cut(cols: dict) -> dict:
        doc, start, length, crc, total, kept = [], [], [], [], [], []
        end = np.array([EOS], dtype="<u4").tobytes()
        texts = [t or "" for t in cols["text"]]
        for d, raw in zip(cols["doc_id"], tokenizer(vocabulary, remembered).ids(texts), strict=True):
            raw += end
            n = len(raw) // 4
            for at in range(0, n, window):
                piece = raw[4 * at : 4 * (at + window)]
                doc.append(d)
                start.append(at)
                length.append(len(piece) // 4)
                crc.append(zlib.crc32(piece))
                total.append(n)
                if keep_ids:
                    kept.append(np.frombuffer(piece, dtype="<i4"))
        out = {"doc_id": doc, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}
        return out | {"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return arrow_pass(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), cut, schema, keeps=True)


class OpenWindows:
    """Segment tree over remaining capacities: each leaf counts the groups of open windows with that capacity."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int, int]]] = [[] for _ in range(self.size)]

    def add(self, left: int, group: tuple[int, int, int]) -> None:
        self.groups[left].append(group)
        self._step(left, 1)

    def take(self, left: int) -> tuple[int, int, int]:
        self._step(left, -1)
        return self.groups[left].pop()

    def _step(self, left: int, by: int) -> None:
        node = left + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """Least remaining capacity of at least ``need`` among open windows."""
        node = need + self.size
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, windows, first window, offset) for ``counts`` pieces of each length.

    Pieces of one length are interchangeable, so they are placed by the group: the ``windows`` pieces from ``first
    rank`` on go, one each, into consecutive windows from ``first window`` on. The result is that of placing pieces
    one at a time, longest first, each into the tightest open window. It has a few entries for each length, however
    many pieces there are.
    """
    open_windows, out, used = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = open_windows.tightest(length)
            if left is None:
                fresh = max(1, todo // (window // length))
                open_windows.add(window, (used, fresh, 0))
                used += fresh
                continue
            first, n, offset = open_windows.take(left)
            k = min(n, todo)
            out.append((length, rank, k, first, offset))
            rank, todo = rank + k, todo - k
            if left > length:
                open_windows.add(left - length, (first, k, offset + length))
            if n > k:
                open_windows.add(left, (first + k, n - k, offset))
    return out


def pack(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset: best-fit decreasing over all pieces of all documents.

    Only the number of pieces of each length, at most ``window`` rows, reaches the driver, which places them by the
    group; each piece then finds its place by its rank among those of its length. Ranks come from a range-sorted
    table, so that copies of one length are spread over tasks. Sequences are numbered without gaps. Ties between
    equal lengths go by doc_id and start; equal rows are interchangeable.
    """
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32")]
    ranked = with_position(cut_lineage(pieces), order, name="__pos")
    sizes = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, start = {}, 0
    for length in sorted(sizes, reverse=True):
        before[length] = start
        start += sizes[length]
    plan = best_fit_decreasing(sizes, window)
    rows = [(length, before[length] + rank, before[length] + rank + n, first, offset) for length, rank, n, first, offset in plan]
    places = pieces.sparkSession.createDataFrame(rows, "__length long, __from long, __to long, __window long, __offset long")
    inside = (F.col("length") == F.col("__length")) & (F.col("__pos") >= F.col("__from")) & (F.col("__pos") < F.col("__to"))
    out = ranked.join(F.broadcast(places), inside)
    return out.select(*pieces.columns, (F.col("__window") + F.col("__pos") - F.col("__from")).alias("sequence_id"), F.col("__offset").alias("offset"))
