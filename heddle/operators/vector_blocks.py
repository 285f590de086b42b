"""Exact comparison of all queries with all vectors by matrix products, in blocks of bounded size.

Both sides are dealt into blocks by a hash of their ids; each two blocks of
equal ``by`` meet in one task, which keeps only what its caller asked for, so
no pair is ever a row of a table unless it is a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a block of vectors, and of queries: at 64 dimensions 50,000 vectors and 15,000 queries.
VECTORS, QUERIES = 3_200_000, 960_000
#: Rows of both sides that are multiplied at once; what rounding to six places may add to a score.
ROWS, COLUMNS, SLACK = 1000, 4000, 1e-6


def unit_matrices(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lists as rows of length 1, with their places: a matrix for each length of list; vectors without a direction become zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        own = lists if len(at) == len(lists) else lists.take(pa.array(at))
        m = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(n))
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        out.append((at, np.divide(m, norm, out=np.zeros_like(m), where=(norm > 0) & np.isfinite(norm))))
    return out


def _tiles(q: np.ndarray, v: np.ndarray):
    for i in range(0, len(q), ROWS):
        for j in range(0, len(v), COLUMNS):
            yield i, j, q[i : i + ROWS] @ v[j : j + COLUMNS].T


def near(q: np.ndarray, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``q`` and ``v``, and scores, of all pairs whose cosine, rounded to six places, is at least ``threshold``."""
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for i, j, s in _tiles(q, v):
        at, to = np.nonzero(s >= threshold - SLACK)
        score = np.round(s[at, to], 6) + 0.0
        fine = score >= threshold
        found.append((at[fine] + i, to[fine] + j, score[fine]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def best(q: np.ndarray, v: np.ndarray, order: np.ndarray, k: int, threshold: float = -2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the ``k`` best of each query from ``threshold`` on, ties to the smaller ``order``."""
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for i in range(0, len(q), ROWS):
        own, least = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), np.full(len(q[i : i + ROWS]), threshold)
        for _, j, s in _tiles(q[i : i + ROWS], v):
            if j == 0 and s.shape[1] > k:
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - SLACK)
            at, to = np.nonzero(s >= least[:, None] - SLACK)
            score = np.round(s[at, to], 6) + 0.0
            at, to, score = (np.concatenate(x) for x in zip(own, (at, to + j, score), strict=True))
            fine = np.lexsort((order[to], -score, at))
            fine = fine[score[fine] >= threshold]
            at, to, score = at[fine], to[fine], score[fine]
            first = np.searchsorted(at, at)
            kept = np.arange(len(at)) - first < k
            own = at, to, score = at[kept], to[kept], score[kept]
            last = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == k - 1)
            least[at[last]] = np.maximum(least[at[last]], score[last] - SLACK)
        found.append((own[0] + i, own[1], own[2]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def compared(queries: DataFrame, vectors: DataFrame, kernel: Callable, by: tuple[str, ...] = (), earlier: bool = False) -> DataFrame:
    """``(query_id, id, score)``, and ``by``, of what ``kernel(q, v, order)`` keeps of ``queries(query_id, embedding, ...)`` and ``vectors(id, embedding, ...)`` of equal ``by``.

    The kernel gets unit rows and the order of the vectors' ids, and returns
    places in both and scores; ``earlier`` leaves those whose query's id is the
    smaller one.  Vectors of different lengths aren't compared; rows without id
    or vector take no part.
    """
    kinds = dict(queries.dtypes), dict(vectors.dtypes)
    keys = by or ("everything",)
    side = lambda df, key: (df if by else df.withColumn("everything", F.lit(0))).where(F.col(key).isNotNull() & F.col("embedding").isNotNull())
    asked, own = side(queries, "query_id"), side(vectors, "id")
    # a block holds so many numbers, whatever the vectors' length
    blocks = lambda most: F.greatest(F.ceil(F.sum(F.size("embedding").cast("long")) / most), F.lit(1)).cast("int")
    parts = asked.groupBy(*keys).agg(blocks(QUERIES).alias("query_parts")).join(own.groupBy(*keys).agg(blocks(VECTORS).alias("vector_parts")), list(keys))
    cut = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, list(keys)).select("query_id", "embedding", *keys, cut("query_id", "query_parts").alias("i"), every("vector_parts").alias("j"))
    other = own.join(parts, list(keys)).select("id", F.col("embedding").alias("vector"), *(F.col(k).alias(f"own_{k}") for k in keys), cut("id", "vector_parts").alias("own_j"), every("query_parts").alias("own_i"))
    schema = ", ".join([f"query_id {kinds[0]['query_id']}, id {kinds[1]['id']}, score double", *(f"`{k}` {kinds[0][k]}" for k in by)])

    def run(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        of, ids = x.column("query_id"), y.column("id")
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(x) and len(y):
            order = np.unique(ids.to_numpy(), return_inverse=True)[1]
            for at, q in unit_matrices(x.column("embedding")):
                for to, v in unit_matrices(y.column("vector")):
                    if q.shape[1] == v.shape[1]:
                        a, b, score = kernel(q, v, order[to])
                        found.append((at[a], to[b], score))
        at, to, score = map(np.concatenate, zip(*found, strict=True))
        if earlier and len(at):
            code = np.unique(np.concatenate([of.to_numpy(), ids.to_numpy()]), return_inverse=True)[1]
            fine = code[at] < code[len(of) + to]
            at, to, score = at[fine], to[fine], score[fine]
        shared = {k: pa.repeat(value, len(at)) for k, value in zip(by, key, strict=False)}
        return pa.table({"query_id": of.take(pa.array(at)), "id": ids.take(pa.array(to)), "score": score} | shared)

    return left.groupBy(*keys, "i", "j").cogroup(other.groupBy(*(f"own_{k}" for k in keys), "own_i", "own_j")).applyInArrow(run, schema)
