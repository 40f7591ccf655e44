"""Sequence alignment scores that need dynamic programming, as Arrow-batched helpers."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as S


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence (bit-parallel over the first sequence)."""
    if not len(a) or not len(b):
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_positions(a, b) -> set[int]:
    """Positions of ``a`` in one longest common subsequence with ``b``."""
    t = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    code = {w: i for i, w in enumerate(set(a) | set(b))}
    bv = np.array([code[w] for w in b], dtype=np.int64)
    for i, x in enumerate(a, 1):
        diag = t[i - 1, :-1] + (bv == code[x])
        t[i, 1:] = np.maximum.accumulate(np.maximum(diag, t[i - 1, 1:]))
    out: set[int] = set()
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i, j - 1] > t[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out


def _words(text: str) -> list[str]:
    return [w for w in re.sub("[^a-z0-9]+", " ", (text or "").lower()).split(" ") if w]


def rouge_lsum(pred: str, ref: str) -> float:
    """Summary-level ROUGE-L: per reference line, the union of its common subsequences with every
    predicted line; each token counts at most as often as both sides have it."""
    refs = [_words(x) for x in (ref or "").split("\n")]
    preds = [_words(x) for x in (pred or "").split("\n")]
    refs, preds = [x for x in refs if x], [x for x in preds if x]
    m, n = sum(map(len, refs)), sum(map(len, preds))
    if not m or not n:
        return 0.0
    left_r, left_p = Counter(w for s in refs for w in s), Counter(w for s in preds for w in s)
    hits = 0
    for r in refs:
        union: set[int] = set()
        for p in preds:
            union |= lcs_positions(r, p)
        for i in sorted(union):
            w = r[i]
            if left_r[w] and left_p[w]:
                hits += 1
                left_r[w] -= 1
                left_p[w] -= 1
    return 2.0 * hits / (m + n)


def edit_ratio(a: str, b: str) -> float:
    """Insert/delete similarity: twice the common subsequence over both lengths, in whole percent."""
    total = len(a) + len(b)
    return round(200.0 * lcs_length(a, b) / total) / 100 if total else 0.0


def _edit_rows(masks: dict[int, int], m: int, words: list[int], state: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """States of the word edit distance to a reference of ``m`` words after each further word, ``state`` first.

    Bit-parallel: a state holds where the row of the table rises and where it falls, and its last entry, which is the
    distance. ``masks`` has the places of each word in the reference.
    """
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, d = state
    states = [state]
    for w in words:
        same = masks.get(w, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        d += 1 if right & last else -1 if left & last else 0
        right, left = (right << 1) | 1, left << 1
        up, down = (left | ~(diagonal | right)) & full, right & diagonal & full
        states.append((up, down, d))
    return states


# Bounds of the block-shift search of the published translation edit rate.
MAX_SHIFT_SIZE = 10
MAX_SHIFT_DISTANCE = 50
MAX_SHIFT_CANDIDATES = 1000


def _shifts(hyp: list[int], ref: list[int]):
    """Blocks of the hypothesis that occur in the reference at another place, and where they can go."""
    at: dict[int, list[int]] = {}
    for j, w in enumerate(ref):
        at.setdefault(w, []).append(j)
    for i in range(len(hyp)):
        for j in at.get(hyp[i], ()):
            if i == j or abs(i - j) > MAX_SHIFT_DISTANCE:
                continue
            size = 0
            while size < MAX_SHIFT_SIZE and i + size < len(hyp) and j + size < len(ref) and hyp[i + size] == ref[j + size]:
                size += 1
                yield i, size, j


def translation_edits(pred: str, ref: str) -> int:
    """Edits to turn the prediction into the reference where moving a block counts as one edit.

    Greedy: as long as some move lowers the edit distance, the one that lowers it most is made. A move leaves the words
    before it as they are, so its distance goes on from their state.
    """
    words = {w: k for k, w in enumerate(dict.fromkeys((pred + " " + ref).split()))}
    h, r = [words[w] for w in pred.split()], [words[w] for w in ref.split()]
    if not r:
        return len(h)
    if not h:
        return len(r)
    masks: dict[int, int] = {}
    for j, w in enumerate(r):
        masks[w] = masks.get(w, 0) | (1 << j)
    rows = _edit_rows(masks, len(r), h, ((1 << len(r)) - 1, 0, len(r)))
    moved, best = 0, rows[-1][2]
    tried = 0
    while best and tried < MAX_SHIFT_CANDIDATES:
        choice = None
        for i, size, j in _shifts(h, r):
            tried += 1
            if tried > MAX_SHIFT_CANDIDATES:
                break
            rest = h[:i] + h[i + size :]
            new = rest[:j] + h[i : i + size] + rest[j:]
            kept = min(i, j)
            d = _edit_rows(masks, len(r), new[kept:], rows[kept])[-1][2]
            key = (best - d, size, -i)
            if d < best and (choice is None or key > choice[0]):
                choice = (key, new)
        if choice is None:
            break
        h = choice[1]
        rows = _edit_rows(masks, len(r), h, rows[0])
        best, moved = rows[-1][2], moved + 1
    return best + moved


def assignment(scores: np.ndarray) -> list[tuple[int, int]]:
    """Row/column pairs of a maximum-score assignment (shortest augmenting paths)."""
    flip = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if flip else scores)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0] = row
        col = 0
        slack = np.full(m + 1, np.inf)
        prev = np.zeros(m + 1, dtype=int)
        done = np.zeros(m + 1, dtype=bool)
        while True:
            done[col] = True
            r = owner[col]
            free = ~done[1:]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = free & (reduced < slack[1:])
            slack[1:][better] = reduced[better]
            prev[1:][better] = col
            nxt = int(np.argmin(np.where(free, slack[1:], np.inf))) + 1
            delta = slack[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            slack[1:][free] -= delta
            col = nxt
            if owner[col] == 0:
                break
        while col:
            owner[col] = owner[prev[col]]
            col = prev[col]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _is_number(w: str) -> bool:
    try:
        float(w)
        return True
    except ValueError:
        return False


_MARKS = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def span_form(text: str) -> str:
    """Comparison form of an answer span: numbers canonical, other words without punctuation and articles."""
    out = []
    for token in re.split("[ -]", text.lower()):
        w = token if _is_number(token) else token.translate(_MARKS)
        w = str(float(w)) if _is_number(w) else w
        w = " ".join(re.sub(r"\b(a|an|the)\b", " ", w).split())
        if w:
            out.append(w)
    return " ".join(out)


def span_scores(pred: list[str], gold: list[str]) -> tuple[float, float]:
    """Exact match of the span sets, and mean F1 over the best one-to-one alignment of spans.

    Spans align only if they share a number whenever the gold span has one.
    """
    p, g = [span_form(x) for x in pred], [span_form(x) for x in gold]
    em = float(set(p) == set(g) and len(p) == len(g))
    if not p or not g:
        return em, 0.0
    bags_p, bags_g = [set(x.split()) for x in p], [set(x.split()) for x in g]
    score = np.zeros((len(g), len(p)))
    for i, gb in enumerate(bags_g):
        numbers = {w for w in gb if _is_number(w)}
        for j, pb in enumerate(bags_p):
            if not numbers or numbers & pb:
                both = len(gb & pb)
                prec = both / len(pb) if pb else 1.0
                rec = both / len(gb) if gb else 1.0
                score[i, j] = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
    total = sum(score[i, j] for i, j in assignment(score))
    return em, float(np.round(total / max(len(g), len(p)), 2))


def _column(fn, kind: S.DataType):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) for x, y in zip(a, b)])

    return run


rouge_lsum_col = _column(rouge_lsum, S.DoubleType())
edit_ratio_col = _column(edit_ratio, S.DoubleType())
lcs_length_col = _column(lambda a, b: lcs_length(list(a), list(b)), S.LongType())
translation_edits_col = _column(translation_edits, S.LongType())


@F.pandas_udf(S.StructType([S.StructField("em", S.DoubleType()), S.StructField("f1", S.DoubleType())]))
def span_scores_col(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    rows = [span_scores(list(p), list(g)) for p, g in zip(pred, gold)]
    return pd.DataFrame(rows, columns=["em", "f1"])


GRAM_COUNTS = S.ArrayType(S.StructType([S.StructField(c, S.LongType()) for c in ("n", "n_pred", "n_ref", "n_common")]))


def gram_counts(pred: str, ref: str, order: int) -> list[tuple[int, int, int, int]]:
    """Per order: character grams of both texts (whitespace removed) and how many they share."""
    p, r = "".join(pred.split()), "".join(ref.split())
    out = []
    for n in range(1, order + 1):
        a = Counter(p[i : i + n] for i in range(len(p) - n + 1))
        b = Counter(r[i : i + n] for i in range(len(r) - n + 1))
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        common = sum(min(c, large[g]) for g, c in small.items() if g in large)
        out.append((n, max(len(p) - n + 1, 0), max(len(r) - n + 1, 0), common))
    return out


def character_gram_counts(order: int):
    @F.pandas_udf(GRAM_COUNTS)
    def run(pred: pd.Series, ref: pd.Series) -> pd.Series:
        names = ("n", "n_pred", "n_ref", "n_common")
        return pd.Series([[dict(zip(names, row)) for row in gram_counts(p or "", r or "", order)] for p, r in zip(pred, ref)])

    return run


def token_gram_counts(orders: tuple[int, ...], rows: int = 256):
    """``(n, n_pred, n_ref, n_common)`` per order of two token arrays; a few rows at a time leave Arrow."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("n", "n_pred", "n_ref", "n_common")]))

    def counts(p: list, r: list) -> list[dict]:
        out = []
        for n in orders:
            a, b = (Counter(zip(*[t[i:] for i in range(n)])) for t in (p, r))
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            common = sum(min(c, large[g]) for g, c in small.items() if g in large)
            out.append({"n": n, "n_pred": max(len(p) - n + 1, 0), "n_ref": max(len(r) - n + 1, 0), "n_common": common})
        return out

    @F.arrow_udf(GRAM_COUNTS)
    def run(pred: pa.Array, ref: pa.Array) -> pa.Array:
        part = lambda x, i: x.slice(i, rows).to_pylist()
        done = [pa.array([counts(p or [], r or []) for p, r in zip(part(pred, i), part(ref, i))], kind) for i in range(0, len(pred), rows)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return run
