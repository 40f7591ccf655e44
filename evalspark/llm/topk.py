"""Exact top-k by inner product: columnar branch and bound over dimension blocks, queries in blocks against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut_lineage

RESULT = "query_id long, rank int, vec_id long, score long"
_CHUNK = 64


def quantized(df: DataFrame, scale: int = 64, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with a null id, a null vector or a null or non-finite
    component are left out. Empty vectors stay: each of their products is zero."""
    x = F.col(vector)
    sound = F.col(key).isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.where(sound).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of one matrix; shorter vectors are filled with zeros."""
    rows = [np.asarray(r.values if hasattr(r, "values") else r, dtype=np.int64) for r in column]
    wide = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), wide), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _kind(q: np.ndarray, c: np.ndarray) -> type:
    """The fastest number type that holds every inner product exactly."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, step: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's best ``k`` among the candidates; ties go to the smaller id.

    Candidates lie in vertical layout: one array for each block of ``step`` dimensions. Scores grow block by block;
    a candidate stays while its score so far plus the product of the norms of what remains can still reach the k-th
    score that some query of the chunk already has. Survivors are compacted after each block.
    """
    wide = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, c))
    kind = _kind(q, c)
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    cuts = list(range(0, wide, step)) or [0]
    columns = [np.ascontiguousarray(c[:, a : a + step].T.astype(kind)) for a in cuts]
    rest = lambda m: np.sqrt(np.cumsum([(m[:, a : a + step].astype(np.float64) ** 2).sum(1) for a in cuts[::-1]], axis=0))[::-1]
    rest_c, rest_q = rest(c), rest(q)
    out_q, out_c, out_s = [], [], []
    probe = np.argsort(-rest_c[0], kind="stable")[: max(4 * k, 256)]
    for at in range(0, len(qid), _CHUNK):
        ids, own = qid[at : at + _CHUNK], q[at : at + _CHUNK].astype(kind)
        low = np.full(len(ids), -np.inf)
        if len(probe) > k:
            first = (own @ c[probe].T.astype(kind)).astype(np.float64)
            first[ids[:, None] == cid[probe][None, :]] = -np.inf
            low = np.partition(first, len(probe) - k, axis=1)[:, len(probe) - k]
        alive = np.arange(len(cid))
        score = np.zeros((len(ids), len(cid)), dtype=kind)
        for b, a in enumerate(cuts):
            score += own[:, a : a + step] @ (columns[b] if len(alive) == len(cid) else columns[b][:, alive])
            if b + 1 < len(cuts):
                bound = score + np.outer(rest_q[b + 1][at : at + _CHUNK], rest_c[b + 1][alive]) * (1 + 1e-9)
                stay = (bound >= low[:, None]).any(axis=0)
                if stay.mean() < 0.75:
                    alive, score = alive[stay], score[:, stay]
        names = cid[alive]
        for i, me in enumerate(ids):
            own_score = score[i]
            ok = np.flatnonzero(names != me) if (names == me).any() else slice(None)
            s, n = own_score[ok], names[ok]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > least)
                keep = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
                s, n = s[keep], n[keep]
            out_q.append(np.full(len(s), me))
            out_c.append(n)
            out_s.append(s.astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, candidate_block: int = 16_384, query_block: int = 16_384) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each of ``queries``, both (vec_id, v) of integers: query_id, rank, vec_id, score.

    Candidates of a query are all rows with another vec_id; a repeated query row counts once. Blocks of queries meet
    blocks of candidates in tasks of their own, so that a hot vector is just rows of some block. Each pair of blocks
    leaves at most ``k`` rows a query, and the best of these are the answer.
    """
    vectors, queries = cut_lineage(vectors), cut_lineage(queries.dropDuplicates())
    n_c = max(1, -(-vectors.count() // candidate_block))
    n_q = max(1, -(-queries.count() // query_block))
    side = lambda df, n: df.withColumn("own", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = side(vectors, n_c).withColumn("other", other(n_q)).select((F.col("own") * n_q + F.col("other")).alias("pair"), F.lit(False).alias("is_query"), "vec_id", "v")
    q = side(queries, n_q).withColumn("other", other(n_c)).select((F.col("other") * n_q + F.col("own")).alias("pair"), F.lit(True).alias("is_query"), "vec_id", "v")

    def run(t: pa.Table) -> pa.Table:
        mask = t["is_query"].to_numpy()
        m, ids = _matrix(t["v"]), t["vec_id"].to_numpy()
        qs, cs, s = search_block(ids[mask], m[mask], ids[~mask], m[~mask], k)
        return pa.table({"query_id": pa.array(qs, pa.int64()), "vec_id": pa.array(cs, pa.int64()), "score": pa.array(s, pa.int64())})

    part = c.unionByName(q).groupBy("pair").applyInArrow(run, "query_id long, vec_id long, score long")
    best = F.row_number().over(_best())
    return part.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
