"""Quality classifier: cumulative-link regression on graded ratings over hashed text, one weight vector for all grades."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import arrow_pass, blocks, cut_lineage, hash_words, let_go, mix
from evalspark.llm.mixing import draw

BITS = 21
SIZE = 1 << BITS
GRADES = 3
#: Kinds of bytes: letters and digits, then other signs; so a word and the signs on it are two tokens.
_KINDS = np.full(256, 2, dtype=np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = 0
_KINDS[[c for c in range(256) if c > 127 or chr(c).isalnum()]] = 1
#: Cells of the marks, beyond those of tokens.
_MARKS = SIZE + np.arange(3)


def rating(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    """Grade of two 0/1 labels: 0 poor, 1 well written but toxic, 2 good; null if a label is null."""
    q, t = F.col(quality), F.col(toxic)
    return F.when(q.isNull() | t.isNull(), None).when(q == 0, 0).when(t == 1, 1).otherwise(2).cast("int")


def features(texts: list[bytes]):
    """(position, cells, values) of each whole text: 1 for each hashed token that it has, and shares for the marks.

    Tokens: lower-cased runs of letters or digits, and runs of other signs. Marks: runs in capitals, runs of signs and
    tokens equal to the one before, each with the square root of its share. One insult in a long text is one cell,
    as in a short one. A text without a token has no features.
    """
    for lo, hi in blocks(texts):
        joined = b"\n".join(texts[lo:hi])
        h, starts, sizes = hash_words(joined, lower=True, kinds=_KINDS)
        x = np.frombuffer(joined, dtype=np.uint8)
        cut = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[lo:hi]])[:-1])
        marks = np.zeros((3, len(h)), bool)
        if len(h):
            upper = (x >= 65) & (x <= 90)
            marks[0] = (sizes > 1) & upper[starts] & upper[np.minimum(starts + 1, len(x) - 1)]
            marks[1, 1:] = h[1:] == h[:-1]
            marks[2] = _KINDS[x[starts]] == 2
        cell = (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
        for i, (own, m) in enumerate(zip(np.split(cell, cut), np.split(marks, cut, axis=1), strict=True)):
            cells = np.unique(own)
            if len(own):
                yield lo + i, np.append(cells, _MARKS), np.append(np.ones(len(cells)), 4 * np.sqrt(m.mean(axis=1)))
            else:
                yield lo + i, cells, np.zeros(0)


def training_sample(docs: DataFrame, ratings: DataFrame, most: int = 6000) -> DataFrame:
    """(grade, text) of about ``most`` rated documents at most, chosen by hash; ``ratings`` has doc_id and grade.

    Ratings of one document are averaged, so that repeated labels count once. Texts are filtered by key before the
    join, so that unrated texts do not move.
    """
    rated = cut_lineage(ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("grade")))
    n = rated.count()
    chosen = cut_lineage(rated.where(draw("quality", "doc_id") < min(1.0, most / max(n, 1))))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


class Ordinal:
    """P(grade > k) = sigmoid(w·x − threshold k); thresholds rise with k."""

    def __init__(self, w: np.ndarray, thresholds: np.ndarray):
        self.w, self.thresholds = w, thresholds

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for k = 0 … GRADES − 2, a row for each text."""
        z = np.zeros(len(texts))
        for i, cells, values in features(texts):
            z[i] = self.w[cells] @ values
        return _sigmoid(z[:, None] - self.thresholds)


def fit_ordinal(texts: list[bytes], grades: np.ndarray, rounds: int = 400, penalty: float = 1e-5, gap: float = 1.0, least_share: float = 0.004) -> Ordinal:
    """Maximum likelihood with an L2 penalty, by accelerated gradient steps. The problem is convex in weights and
    thresholds; thresholds stay at least ``gap`` apart, which keeps its curvature bounded.

    Grades weigh alike, whatever their shares; cells in a smaller share of texts than ``least_share`` keep weight 0,
    and frequent cells are scaled down. Without rows, or with one grade only, the thresholds put all mass there.
    """
    top, n = GRADES - 1, len(grades)
    if len(set(grades.tolist())) < 2:
        g = int(grades[0]) if n else top
        return Ordinal(np.zeros(SIZE + len(_MARKS), np.float32), np.array([-9.0 if k < g else 9.0 for k in range(top)]))
    parts = list(features(texts))
    cell, value = np.concatenate([c for _, c, _ in parts]), np.concatenate([v for _, _, v in parts])
    owner = np.repeat([i for i, _, _ in parts], [len(c) for _, c, _ in parts])
    seen = np.bincount(cell, minlength=SIZE + len(_MARKS))
    active = np.flatnonzero(seen >= max(2, least_share * n))
    scale = 1 / np.sqrt(1 + 30 * seen[active] / n)
    scale[active >= SIZE] = 1.0
    place = np.full(len(seen), -1)
    place[active] = np.arange(len(active))
    use = place[cell] >= 0
    owner, value, cell = owner[use], value[use] * scale[place[cell[use]]], place[cell[use]]
    share = np.bincount(grades, minlength=GRADES)
    weight = (1 / (share.clip(1) * (share > 0).sum()))[grades]
    rows = np.arange(n)
    forward = lambda w: np.bincount(owner, weights=w[cell] * value, minlength=n)
    back = lambda d: np.bincount(cell, weights=d[owner] * value, minlength=len(active))
    probe = np.ones(len(active))
    for _ in range(12):  # the largest curvature, by power iteration
        probe /= np.linalg.norm(probe)
        probe = back(weight * forward(probe))
    step = 1 / (0.5 * np.linalg.norm(probe) + 0.5)
    w = last_w = np.zeros(len(active))
    cuts = last_cuts = gap * (np.arange(top) - top / 2)
    for turn in range(rounds):
        push = turn / (turn + 3)
        at_w, at_cuts = w + push * (w - last_w), cuts + push * (cuts - last_cuts)
        tail = np.hstack([np.ones((n, 1)), _sigmoid(forward(at_w)[:, None] - at_cuts), np.zeros((n, 1))])
        slope = tail * (1 - tail)
        per = weight / np.maximum(tail[rows, grades] - tail[rows, grades + 1], 1e-12)
        dw = back(-per * (slope[rows, grades] - slope[rows, grades + 1])) + penalty * at_w
        dcuts = np.array([(per * slope[:, k + 1] * ((grades == k + 1).astype(int) - (grades == k))).sum() for k in range(top)])
        last_w, last_cuts = w, cuts
        w, cuts = at_w - step * dw, at_cuts - step * dcuts
        for k in range(1, top):
            cuts[k] = max(cuts[k], cuts[k - 1] + gap)
    full = np.zeros(SIZE + len(_MARKS), np.float32)
    full[active] = w * scale
    return Ordinal(full, cuts)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -40, 40)))


def fit(sample: DataFrame) -> Ordinal:
    """The model of a bounded sample, fitted in one task; only the weights of active cells and thresholds reach the driver."""

    def train(t: pa.Table) -> pa.Table:
        let_go()
        t = t.sort_by("doc_id")
        m = fit_ordinal([(x or "").encode() for x in t["text"].to_pylist()], t["grade"].to_numpy())
        cells = np.flatnonzero(m.w)
        return pa.table({"cells": [cells], "w": [m.w[cells]], "thresholds": [m.thresholds]}, schema=pa.schema([("cells", pa.list_(pa.int64())), ("w", pa.list_(pa.float32())), ("thresholds", pa.list_(pa.float64()))]))

    rows = sample.groupBy(F.lit(0).alias("one")).applyInArrow(train, "cells array<long>, w array<float>, thresholds array<double>").collect()
    if not rows:
        return fit_ordinal([], np.zeros(0, np.int64))
    w = np.zeros(SIZE + len(_MARKS), np.float32)
    w[np.array(rows[0]["cells"], dtype=np.int64)] = rows[0]["w"]
    return Ordinal(w, np.array(rows[0]["thresholds"]))


def graded(df: DataFrame, model: Ordinal, least_tail: float = 0.5) -> DataFrame:
    """All columns of ``df`` with __expected_grade, __tail (probability of the best grade) and __kept.

    Every whole text is read; a null text is empty. A text without a token has nothing against it and is kept; its
    grade follows from the thresholds alone. Repeated rows get equal results.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __expected_grade double, __tail double, __kept boolean"

    def run(cols: dict) -> dict:
        texts = [(t or "").encode() for t in cols["text"]]
        tails = shared.value.tails(texts)
        kept = (tails[:, -1] >= least_tail) | np.array([not t.strip() for t in texts], dtype=bool)
        return {c: cols[c] for c in names} | {"__expected_grade": tails.sum(axis=1), "__tail": tails[:, -1], "__kept": kept}

    return arrow_pass(df, run, schema)
