"""Embedding whitening: leading eigenpairs of the covariance by spectrum slicing and Rayleigh quotient iteration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added to each integer component, as the contract of the digest says; it cancels in every difference.
OFFSET = 1_000_000
SCALE = 64
#: Eigenvalues nearer than this share of the largest are one cluster, whose vectors are kept orthogonal to each other.
CLUSTER = 1e-7
#: Components below this share of the largest eigenvalue are rounding noise and have no whitened value.
RANK = 1e-12
_LONG = 2**63 - 1


# --- eigenpairs of one matrix ----------------------------------------------------------------------


def count_above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of symmetric ``v`` above ``shift``: positive ones in D of LDLᵀ of v − shift·I.

    Symmetric pivoting with blocks of one or two rows keeps the factors bounded, so the inertia is that of a matrix
    very near the shifted one, whatever the shift. A pivot of exactly zero counts as not above.
    """
    a = v - shift * np.eye(len(v))
    alpha, above = (1 + 17**0.5) / 8, 0
    while len(a):
        off = np.abs(a[1:, 0])
        r = int(off.argmax()) + 1 if len(off) else 0
        most = off[r - 1] if len(off) else 0.0
        size, first = 1, 0
        if most > 0 and abs(a[0, 0]) < alpha * most:
            row = np.abs(a[r])
            row[r] = 0
            widest = row.max()
            if abs(a[0, 0]) * widest < alpha * most * most:
                if abs(a[r, r]) >= alpha * widest:
                    first = r
                else:
                    size, first = 2, r
        at = 0 if size == 1 else 1
        if first != at:
            a[[at, first]] = a[[first, at]]
            a[:, [at, first]] = a[:, [first, at]]
        if size == 1:
            pivot = a[0, 0]
            above += pivot > 0
            col = a[1:, 0]
            a = a[1:, 1:] - np.outer(col, col / pivot) if pivot != 0 else a[1:, 1:]
        else:  # a block of two rows has one eigenvalue of each sign
            above += 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[2:, :2].T)
    return int(above)


def eigenvalue(v: np.ndarray, k: int, bound: float) -> float:
    """The ``k``-th largest eigenvalue (from 1) to about 14 digits of ``bound``, by halving an interval on the counts."""
    low, high = -0.0173 * bound, 1.0173 * bound
    while high - low > 4e-15 * bound:
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if count_above(v, mid) >= k else (low, mid)
    return (low + high) / 2


def eigenpair(v: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """(eigenvalue, unit eigenvector) number ``k`` of a covariance ``v``, from 1 by falling eigenvalue.

    Counts isolate the eigenvalue and so certify its number. Inverse iteration at that value gives a vector that
    Rayleigh quotient iteration polishes, cubically; a quotient that leaves the isolated value is refused. Vectors of
    a cluster are found one after another, each orthogonal to those before it, from fixed starts, so that tasks which
    solve different members agree. The entry of largest size is positive.
    """
    bound = float(np.abs(v).sum(axis=1).max())
    if bound == 0:
        return 0.0, np.eye(len(v))[k - 1]
    value = {k: eigenvalue(v, k, bound)}
    first = k
    while first > 1:
        value[first - 1] = eigenvalue(v, first - 1, bound)
        if value[first - 1] - value[first] > CLUSTER * bound:
            break
        first -= 1
    found: list[np.ndarray] = []
    for j in range(first, k + 1):
        x = np.random.default_rng(j).standard_normal(len(v))
        shift = value[j]
        best, rho = np.inf, shift
        for step in range(12):
            try:
                y = np.linalg.solve(v - shift * np.eye(len(v)), x)
            except np.linalg.LinAlgError:
                y = np.linalg.solve(v - (shift + 1e-15 * bound) * np.eye(len(v)), x)
            for _ in range(2):
                for z in found:
                    y = y - (z @ y) * z
            y /= np.linalg.norm(y)
            quotient = float(y @ v @ y)
            left = float(np.linalg.norm(v @ y - quotient * y))
            if step > 1 and (left >= best or abs(quotient - value[j]) > CLUSTER * bound):
                break
            x, best, rho = y, left, quotient
            shift = quotient if step else value[j]
        found.append(x)
    if abs(rho - value[k]) > CLUSTER * bound:
        raise ArithmeticError(f"component {k}: the quotient {rho} left the eigenvalue {value[k]} that the counts isolate")
    x = found[-1]
    return rho, x if x[np.abs(x).argmax()] > 0 else -x


# --- passes over the vectors -----------------------------------------------------------------------


def sound(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v) of rows whose vector is not null and holds neither null nor non-finite entries; a null id stays."""
    x = F.col(vector)
    ok = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def _whole(column: pa.Array, wide: int) -> np.ndarray:
    """floor(SCALE · c) of each component, as whole numbers in doubles; shorter vectors are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(sizes), wide))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Fit:
    """What all passes share: number of vectors, sums per dimension, a whole-number centre, and later the components."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums, self.most = n, sums, most
        self.centre = np.array([round(s / n) for s in sums], dtype=np.float64) if n else np.zeros(0)
        self.rest = [s - n * int(c) for s, c in zip(sums, self.centre, strict=True)]
        self.values, self.vectors, self.trace, self.identity_error = np.zeros(0), np.zeros((0, len(sums))), 0.0, 0.0

    @property
    def wide(self) -> int:
        return len(self.sums)

    def exact(self) -> bool:
        """Whether products summed over all rows stay exact in 64 bits."""
        return self.n * (2 * self.most + 1) ** 2 < 2**62

    def centred(self, column: pa.Array) -> np.ndarray:
        return _whole(column, self.wide) - self.centre

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """x − S/n on each component, over the root of its eigenvalue."""
        mean = np.array([r / self.n for r in self.rest])
        return (y - mean) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, y: np.ndarray) -> list:
        """Σ (n·x − S)² of each row, exact; null where 64 bits cannot hold it."""
        if self.wide * (self.n * (2 * self.most + 2)) ** 2 < _LONG:
            d = self.n * y.astype(np.int64) - np.array(self.rest, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        sums = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in y.tolist()]
        return [s if s <= _LONG else None for s in sums]


def sums_of(vectors: DataFrame) -> Fit:
    """Number of vectors, exact sum per dimension and largest size of a component; one row per task and dimension
    is shuffled and one per dimension reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, [], 0
        for b in batches:
            if b.num_rows:
                column = b["v"]
                y = _whole(column, int(np.diff(column.offsets.to_numpy()).max()))
                n += len(y)
                most = max(most, int(np.abs(y).max(initial=0)))
                own = y.astype(np.int64).sum(axis=0).tolist() if most * len(y) < 2**62 else [sum(int(v) for v in c) for c in y.T.tolist()]
                total += [0] * (len(own) - len(total))
                total[: len(own)] = [a + s for a, s in zip(total, own)]
        if n:  # position -1 carries the number of rows
            size = len(total) + 1
            yield pa.RecordBatch.from_pydict({"pos": list(range(-1, size - 1)), "s": [str(n), *map(str, total)], "most": [str(most)] * size})

    parts = vectors.select("v").mapInArrow(run, "pos long, s string, most string")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    rows = parts.groupBy("pos").agg(F.sum(whole("s")).alias("s"), F.max(whole("most")).alias("most")).collect()
    by = {r["pos"]: int(r["s"]) for r in rows}
    return Fit(by.pop(-1, 0), [by[i] for i in range(len(by))], max((int(r["most"]) for r in rows), default=0))


def _products(vectors: DataFrame, rows_of) -> list[list[float | int]]:
    """Σ rowᵀ·row over all rows that ``rows_of`` makes of a batch, and Σ row as the last line. Each task adds up its
    own batches; lines of the partial matrices are summed by line, so nothing grows with the number of vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                y = rows_of(b["v"])
                own = np.vstack([y.T @ y, y.sum(axis=0)])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"line": pa.array(range(len(total)), pa.int32()), "v": pa.array(total.tolist(), pa.list_(pa.float64() if total.dtype == np.float64 else pa.int64()))})

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for line, v in zip(b["line"].to_pylist(), b["v"], strict=True):
                held[line] = held.get(line, 0) + v.values.to_numpy()
        if held:
            yield pa.RecordBatch.from_pydict({"line": pa.array(held, pa.int32()), "v": pa.array([v.tolist() for v in held.values()], kind)})

    whole = getattr(rows_of, "whole", False)
    kind = pa.list_(pa.int64() if whole else pa.float64())
    schema = f"line int, v array<{'long' if whole else 'double'}>"
    parts = vectors.select("v").mapInArrow(run, schema)
    lines = parts.repartition("line").mapInArrow(added, schema)
    return [r["v"] for r in sorted(lines.collect())]


def covariance(vectors: DataFrame, fit: Fit) -> np.ndarray:
    """Covariance of the vectors, divisor n. Components are centred on whole numbers before they are multiplied; the
    sums are exact and what the whole-number centre leaves is taken off exactly, so each entry is rounded once. Where
    64 bits cannot hold the sums, doubles centred on the mean are multiplied."""
    n, rest = fit.n, fit.rest
    if not fit.exact():
        mean = np.array([r / n for r in rest])

        def near(column: pa.Array) -> np.ndarray:
            return fit.centred(column) - mean

        lines = np.array(_products(vectors, near))
        return (lines[:-1] - np.outer(lines[-1], lines[-1]) / n) / n

    def whole(column: pa.Array) -> np.ndarray:
        return fit.centred(column).astype(np.int64)

    whole.whole = True
    lines = _products(vectors, whole)
    return np.array([[(n * lines[i][j] - rest[i] * rest[j]) / (n * n) for j in range(fit.wide)] for i in range(fit.wide)])


def fitted(vectors: DataFrame, components: int = 32) -> Fit:
    """Sums, covariance and leading eigenpairs of ``vectors`` (vec_id, v), and the measured error of whitening.

    Three scans of the vectors; each component is solved by a task of its own. The driver holds matrices whose size
    depends on the dimension alone.
    """
    fit = sums_of(vectors)
    if not fit.n or not fit.wide:
        return fit
    v = covariance(vectors, fit)
    fit.trace = float(np.trace(v))
    last = min(components, fit.wide)

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b["id"].to_pylist():
                value, vector = eigenpair(v, k)
                yield pa.RecordBatch.from_pydict({"k": [k], "value": [value], "vector": [vector.tolist()]})

    spark = vectors.sparkSession
    solved = sorted(spark.range(1, last + 1, 1, last).mapInArrow(solve, "k long, value double, vector array<double>").collect())
    kept = [r for r in solved if r["value"] > RANK * max(solved[0]["value"], 0)]
    fit.values, fit.vectors = np.array([r["value"] for r in kept]), np.array([r["vector"] for r in kept]).reshape(len(kept), fit.wide)
    if kept:

        def white(column: pa.Array) -> np.ndarray:
            return fit.whitened(fit.centred(column))

        lines = np.array(_products(vectors, white))
        mean = lines[-1] / fit.n
        fit.identity_error = float(np.abs(lines[:-1] / fit.n - np.outer(mean, mean) - np.eye(len(kept))).max())
    return fit


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, fit: Fit) -> DataFrame:
    """A row for each vector of (vec_id, v) and component of ``fit``: the whitened coordinate, the component's share of
    the trace, the measured error, and the vector's exact deviation.

    Repeated rows and null ids stay rows. Vectors shorter than the longest are filled with zeros. Components that the
    vectors do not span (fewer vectors or dimensions than components, equal vectors) have no rows, so a table without
    two different vectors gives none.
    """
    many = len(fit.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = fit.values / fit.trace if many else fit.values
        for whole in batches:
            for at in range(0, whole.num_rows if many else 0, 2048):
                b = whole.slice(at, 2048)
                y = fit.centred(b["v"])
                size = len(y) * many
                take = np.repeat(np.arange(len(y)), many)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": b["vec_id"].take(pa.array(take)),
                        "component": pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(y))),
                        "n": pa.array(np.full(size, fit.n, dtype=np.int64)),
                        "deviation": pa.array(fit.deviation(y), pa.int64()).take(pa.array(take)),
                        "whitened": pa.array(fit.whitened(y).ravel()),
                        "explained": pa.array(np.tile(share, len(y))),
                        "identity_error": pa.array(np.full(size, fit.identity_error)),
                    }
                )

    return vectors.select("vec_id", "v").mapInArrow(run, RESULT)
