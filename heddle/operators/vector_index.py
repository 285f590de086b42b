"""A vector index of inverted lists: cells around centres, written by cell, with exact ranking.

The centres are fitted on a bounded sample; every vector is then assigned to its
nearest one, and the cell keeps its radius, the widest angle of a member.  By
the triangle inequality on the sphere a cell can only hold a vector within some
angle of a query if the query is no farther from the centre than that angle and
the radius, so :func:`near_pairs` and ``search(exact=True)`` lose nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.session import materialize

#: Cells, vectors of the sample, rounds of fitting; vectors of a cell, and queries, that meet in one task.
CELLS, SAMPLE, ROUNDS, BLOCK = 64, 10_000, 8, 1000
#: Added to angles before cells are left out, as scores are rounded to six places.
SLACK = 2e-3


def unit_rows(values: list) -> np.ndarray:
    """Vectors as rows of length 1; zero vectors stay zero."""
    m = np.array([np.asarray(v, dtype=np.float64) for v in values])
    if not len(values):
        return np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def angles(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ centres.T, -1.0, 1.0))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor empty, without null and non-finite components, and not zero: only these have a cosine."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & e.isNotNull() & fine)


def fit_cells(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centres of at most ``cells`` cells, from the ``sample`` vectors of the least hashes of their ids: the only part that is sampled."""
    rows = usable(vectors).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    m = np.unique(unit_rows([r["embedding"] for r in rows]), axis=0)
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)] if len(m) else m
    for _ in range(rounds if len(m) > len(centres) else 0):
        own = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` with their ``cell`` and the ``angle`` to its centre; rows without a cosine are left out."""
    names = vectors.columns
    at = names.index("embedding")

    def run(batches):
        for batch in batches:
            a = angles(unit_rows(batch.column(at).to_pylist()), centres) if batch.num_rows else np.zeros((0, 1))
            cell = a.argmin(axis=1)
            columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(a[np.arange(len(a)), cell])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "cell", "angle"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return usable(vectors).mapInArrow(run, f"{fields}, cell int, angle double")


@dataclass
class VectorIndex:
    """Where the lists are, and what the driver knows of the cells: their number bounds it."""

    lists: DataFrame
    centres: np.ndarray
    radius: np.ndarray

    @staticmethod
    def of(lists: DataFrame, centres: np.ndarray) -> VectorIndex:
        radius = np.full(len(centres), -np.inf)
        for r in lists.groupBy("cell").agg(F.max("angle").alias("radius")).collect():
            radius[r["cell"]] = r["radius"]
        return VectorIndex(lists, centres, radius)


def write_index(vectors: DataFrame, path: str, cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """Writes every vector ``(id, embedding, ...)`` to its cell's folder, and the centres beside them."""
    spark = vectors.sparkSession
    centres = fit_cells(vectors, cells, sample)
    placed = assigned(vectors, centres)
    # a large cell is several files, of tasks of even size
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return open_index(spark, path, placed.schema)


def open_index(spark: SparkSession, path: str, schema=None) -> VectorIndex:
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    if not len(centres):  # no list was written that could tell the columns
        return VectorIndex.of(spark.createDataFrame([], schema or "id long, embedding array<double>, cell int, angle double"), centres)
    lists = spark.read.parquet(f"{path}/lists")
    return VectorIndex.of(lists, centres)


def _routed(queries: DataFrame, chosen) -> DataFrame:
    """A row of ``queries`` for each cell that ``chosen(unit rows, batch)`` marks, as ``cell``."""
    names = queries.columns
    at = names.index("embedding")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, cell = np.nonzero(chosen(unit_rows(batch.column(at).to_pylist()), batch))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(cell, pa.int32())], names=[*names, "cell"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInArrow(run, f"{fields}, cell int")


def _meet(routed: DataFrame, lists: DataFrame, kernel, schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Queries and vectors of a cell (and equal ``by``) in blocks of bounded size; ``kernel`` gets unit rows and ids of both sides."""
    keys = ["cell", *by]
    left = materialize(routed.select("query_id", "embedding", *keys), "routed")
    counts = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    parts = counts(left, "query_parts").join(counts(lists, "list_parts"), keys)
    cut = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(parts, keys).select("query_id", "embedding", *keys, cut("query_id", "query_parts").alias("i"), every("list_parts").alias("j"))
    other = lists.join(parts, keys).select(F.col("id"), F.col("embedding").alias("vector"), *(F.col(k).alias(f"own_{k}") for k in keys), cut("id", "list_parts").alias("own_j"), every("query_parts").alias("own_i"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (x.schema.field("query_id").type, y.schema.field("id").type, pa.float64()), strict=True)})
        q, v = unit_rows(x.column("embedding").to_pylist()), unit_rows(y.column("vector").to_pylist())
        at, to, score = kernel(np.round(q @ v.T, 6) + 0.0, x.column("query_id"), y.column("id"))
        return pa.table(dict(zip(names, (x.column("query_id").take(pa.array(at)), y.column("id").take(pa.array(to)), pa.array(score)), strict=True)))

    return left.groupBy(*keys, "i", "j").cogroup(other.groupBy(*(f"own_{k}" for k in keys), "own_i", "own_j")).applyInArrow(run, schema)


def near_pairs(queries: DataFrame, index: VectorIndex, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, id, score)`` of all queries ``(query_id, embedding, ...)`` and vectors of equal ``by`` whose cosine, rounded to six places, is at least ``threshold``.

    Exact for thresholds over 0: cells that can't hold such a vector are left
    out, no other.  Vectors of another length than the index's are similar to none.
    """
    if threshold <= 0:
        raise ValueError("vectors without a direction would be similar to all")
    centres, reach = index.centres, index.radius + np.arccos(threshold) + SLACK
    if not len(centres):
        kinds = dict(queries.dtypes), dict(index.lists.dtypes)
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]['query_id']}, id {kinds[1]['id']}, score double")
    fit = usable(queries.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id").where(F.size("embedding") == centres.shape[1])
    routed = _routed(fit.select("query_id", "embedding", *by), lambda m, _: angles(m, centres) <= reach)

    def kernel(scores, of, ids):
        at, to = np.nonzero(scores >= threshold)
        return at, to, scores[at, to]

    kinds = dict(queries.dtypes)["query_id"], dict(index.lists.dtypes)["id"]
    return _meet(routed, index.lists, kernel, f"query_id {kinds[0]}, id {kinds[1]}, score double", by)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, exact: bool = False) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` vectors of largest cosine, rounded to six places, that the ``probes`` nearest cells of each query hold.

    Only these cells' folders are read.  Ties go to the smaller id.  With
    ``exact`` the other cells are read as well where their radius allows a
    vector as near as the ``k``-th one found, so that none is missed.
    """
    centres, radius = index.centres, index.radius
    kinds = dict(queries.dtypes)["query_id"], dict(index.lists.dtypes)["id"]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if not len(centres):
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    queries = usable(queries.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id").where(F.size("embedding") == centres.shape[1])
    queries = queries.select("query_id", "embedding")

    def nearest(m):
        a = angles(m, centres)
        a[:, ~np.isfinite(radius)] = np.inf  # nobody lives there
        return np.argsort(a, axis=1, kind="stable")[:, :probes]

    def first(m, _):
        mark = np.zeros((len(m), len(centres)), dtype=bool)
        np.put_along_axis(mark, nearest(m), True, axis=1)
        return mark

    def kernel(scores, of, ids):
        ids = ids.to_numpy()
        found = []
        for i, own in enumerate(scores):
            near = np.flatnonzero(own >= np.partition(own, -k)[-k]) if len(own) > k else np.arange(len(own))
            near = near[np.lexsort((ids[near], -own[near]))][:k]
            found.append((np.full(len(near), i), near, own[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def met(routed):
        routed = materialize(routed, "routed")
        cells = [r["cell"] for r in routed.select("cell").distinct().collect()]  # as many as cells at most
        return _meet(routed, index.lists.where(F.col("cell").isin(cells)), kernel, schema)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1
    best = lambda pairs: pairs.withColumn("rank", rank).where(F.col("rank") < k)
    found = best(met(_routed(queries, first)))
    if not exact:
        return found
    found = materialize(found.drop("rank"), "found")
    worst = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("worst"))
    open_queries = queries.join(worst, "query_id", "left").select("query_id", "embedding", F.coalesce("worst", F.lit(-1.0)).alias("worst"))

    def rest(m, batch):
        reach = np.arccos(np.clip(batch.column(2).to_numpy(zero_copy_only=False), -1.0, 1.0))[:, None] + SLACK
        return (angles(m, centres) - radius <= reach) & ~first(m, batch) & np.isfinite(radius)

    return best(found.union(met(_routed(open_queries, rest))))
