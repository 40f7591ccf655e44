"""Scorer plug-ins: fill responses for a request table through ``mapInPandas``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Score = Callable[[pd.DataFrame], pd.DataFrame]


def score_requests(requests: DataFrame, score: Score, outputs: T.StructType) -> DataFrame:
    """``score`` maps a batch of request rows to a frame with the output columns, row for row."""
    schema = T.StructType([*requests.schema.fields, *outputs.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = score(batch)
            yield pd.concat([batch.reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return requests.mapInPandas(run, schema)


LIKELIHOOD = T.StructType([T.StructField("loglik", T.DoubleType()), T.StructField("is_greedy", T.BooleanType())])
GENERATION = T.StructType([T.StructField("resp", T.StringType())])


def length_likelihood(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model: longer continuations are less likely."""
    n = batch["continuation"].str.len()
    return pd.DataFrame({"loglik": -n / 10.0, "is_greedy": n % 2 == 0})


def constant_answer(answer: str) -> Score:
    return lambda batch: pd.DataFrame({"resp": [answer] * len(batch)})


Update = Callable[[list[float], pd.DataFrame], list[float]]
Merge = Callable[[list[float], list[float]], list[float]]
SALTS = 256


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays of one type differ; nulls are equal to each other, and so are NaNs."""
    out = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        out = pc.and_(out, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
    return out.to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """``starts a group, rows`` for each run of equal ``by`` values of a sorted partition; a run ends with its batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.select(by)
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is None or any(_differs(x[:1], y[:1])[0] for x, y in zip(last.columns, keys.columns))
        for c in keys.columns:
            new[1:] |= _differs(c[1:], c[:-1])
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            yield bool(new[lo]), batch.slice(lo, hi - lo)
        last = keys.slice(batch.num_rows - 1)


def _fold(df: DataFrame, by: list[str], carry: list[str], start: list[float] | None, step: Callable) -> DataFrame:
    """One ``state`` for each run of equal ``by`` and ``carry`` in the sorted partitions of ``df``; a task holds one state
    and one block of finished ones. ``step(state, rows)`` gets ``start`` as the first state of a group."""
    keys = [*by, *carry]
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField("state", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, states = [], []
        block = lambda: pa.RecordBatch.from_arrays(
            [*[c.combine_chunks() for c in pa.Table.from_batches(done).columns], pa.array(states, pa.list_(pa.float64()))], [*keys, "state"]
        )
        for first, rows in _runs(batches, keys):
            if first and len(states) == 4096:
                yield block()
                done, states = [], []
            if first:
                done.append(rows.select(keys).slice(0, 1))
                states.append(None if start is None else list(start))
            states[-1] = step(states[-1], rows)
        if states:
            yield block()

    return df.sortWithinPartitions(*keys).mapInArrow(run, schema)


def custom_aggregate(
    samples: DataFrame,
    by: list[str],
    update: Update,
    merge: Merge,
    finish: Callable[[list[float]], float],
    start: list[float],
) -> DataFrame:
    """``by, value``: a user's own aggregate. ``update(state, rows)`` folds rows into a state of fixed length, ``merge(a, b)``
    joins two states and has to be associative and commutative, ``finish(state)`` gives the value.

    Rows are folded where they lie, sorted by group, so a hot group is spread over all tasks that hold its rows and a
    task has one open state. The states of a group then meet in two levels, first within ``SALTS`` salts and then at one
    place, so the last task of a group merges at most ``SALTS`` states however many tasks there were. A null or NaN in
    ``by`` is a group of its own; an empty input has no groups.
    """
    join = lambda state, rows: _merged(state, rows.column("state").to_pylist(), merge)
    parts = samples.withColumn("__salt", F.spark_partition_id() % SALTS)
    states = _fold(parts, by, ["__salt"], start, lambda state, rows: update(state, rows.drop_columns(["__salt"]).to_pandas()))
    states = _fold(states.repartition(*by, "__salt"), by, ["__salt"], None, join).drop("__salt")
    states = _fold(states.repartition(*by), by, [], None, join)
    schema = T.StructType([*[samples.schema[c] for c in by], T.StructField("value", T.DoubleType())])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [float(finish(s)) for s in batch.column("state").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(by).columns, pa.array(out, pa.float64())], [*by, "value"])

    return states.mapInArrow(values, schema)


def _merged(state: list[float] | None, more: list[list[float]], merge: Merge) -> list[float]:
    for s in more:
        state = s if state is None else merge(state, s)
    return state
