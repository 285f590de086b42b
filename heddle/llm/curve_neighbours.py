"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors onto a few random directions, shifts the grid at
random and orders the vectors by their place on a Hilbert curve through it.
Spark sorts each order over range partitions; positions in it are dealt into
blocks, and a query meets the vectors of its own block and of the two next to
it.  What the curves' windows give is merged and ranked by the exact measure.

Largest inner products become nearest neighbours by one more coordinate that
gives all vectors the same length and is 0 for queries.  Equal vectors are one
class, which takes part once, so that no window fills with copies.

Curves are added in rounds until a sample of the queries, for which all vectors
are searched, finds the asked share of its true neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.session import free, materialize

from .common import table

#: Neighbours asked for; curves of a round; directions of a curve and bits of each; vectors of a block.
K, CURVES, AXES, BITS, BLOCK = 20, 12, 12, 5, 2048
#: Share of true neighbours at which no more curves are added, and the number of queries for which it is measured.
RECALL, SAMPLE = 0.95, 128
#: Logistic function with the slope that comes next to the normal distribution's.  Fixed value.
SLOPE = 1.702


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells, one row of coordinates each (transposition by Gray code, Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in x:
            upper = (axis >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(upper, low, swap)
            axis ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(flip)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> level & 1)
    return key


class Curves:
    """The curves of one round; the same on every machine, as they follow from the seed."""

    def __init__(self, seed: int, size: int, curves: int, axes: int, bits: int):
        rng = np.random.default_rng(seed)
        axes = min(axes, size + 1)
        self.curves, self.axes, self.bits = curves, axes, bits
        self.directions = np.concatenate([np.linalg.qr(rng.standard_normal((size + 1, axes)))[0] for _ in range(curves)], axis=1)
        self.shifts = rng.random(curves * axes)
        self.mean, self.scale = np.zeros(curves * axes), np.ones(curves * axes)

    def projected(self, vectors: np.ndarray, longest: float) -> np.ndarray:
        """With the coordinate that fills each vector up to the longest one's length."""
        rest = np.sqrt(np.maximum(longest - (vectors * vectors).sum(axis=1), 0.0))
        return vectors @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def keys(self, y: np.ndarray) -> np.ndarray:
        """A column of places for each curve."""
        t = 1 / (1 + np.exp(np.clip(-SLOPE * (y - self.mean) / self.scale, -700, 700)))
        cells = ((t + self.shifts) / 2 * (1 << self.bits)).astype(np.int64).clip(0, (1 << self.bits) - 1)
        return np.stack([hilbert_keys(own, self.bits) for own in np.split(cells, self.curves, axis=1)], axis=1)


def as_matrix(column) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` largest scores."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def scored(queries: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The measure of each query and its ``at``, computed alike wherever a pair meets."""
    return np.stack([np.einsum("ij,ij->i", queries, vectors[at[:, j]]) for j in range(at.shape[1])], axis=1) if at.shape[1] else np.zeros(at.shape)


def vector_classes(rows: DataFrame, k: int, is_query: Column) -> tuple[DataFrame, DataFrame, int]:
    """Written tables: ``(cls, vector, asked)`` of distinct vectors, ``(cls, vec_id, query)`` of rows; and the vectors' length.

    A class goes by its least id.  The second table has all query rows, and of
    the others the ``k + 1`` smallest ids of a class.
    """
    fine = F.col("vector").isNotNull() & F.col("vec_id").isNotNull()
    fine &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine)
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = size["size"] if size else 1
    # equal numbers in one form: -0.0 becomes 0.0
    rows = rows.where(F.size("vector") == size).select("vec_id", F.transform("vector", lambda x: x + F.lit(0.0).cast("float")).alias("vector"))
    rows = materialize(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("query", is_query), "vectors")
    # the window's limit acts before the shuffle too, so that copies don't meet in one task
    order = Window.partitionBy("vector", "query").orderBy("vec_id")
    first = rows.where("not query").withColumn("no", F.row_number().over(order)).where(F.col("no") <= k + 1).drop("no")
    kept = first.union(rows.where("query")).withColumn("digest", F.xxhash64("vector"))
    kept = materialize(kept, "kept")
    classes = materialize(kept.groupBy("digest", "vector").agg(F.min("vec_id").alias("cls"), F.max("query").alias("asked")), "classes")
    members = materialize(kept.join(classes.select("digest", "vector", "cls"), ["digest", "vector"]).select("cls", "vec_id", "query"), "members")
    free(rows, kept)
    return classes.select("cls", "vector", "asked"), members, size


def blocks_of(classes: DataFrame, curves: Curves, longest: float, block: int) -> DataFrame:
    """``(cls, block)`` for each class and curve, as a written table."""
    n = curves.curves * curves.axes

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, n))
        for batch in batches:
            y = curves.projected(as_matrix(batch.column(0)), longest)
            total += np.stack([np.full(n, float(len(y))), y.sum(axis=0), (y * y).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), *map(pa.array, total)], names=["axis", "n", "s", "q"])

    if classes.isEmpty():
        return materialize(classes.select("cls", F.lit(0).cast("long").alias("block")), "blocks")
    parts = classes.select("vector").mapInArrow(sums, "axis int, n double, s double, q double")
    stats = parts.groupBy("axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("axis").collect()
    count, s, q = (np.array([r[c] for r in stats]) for c in "nsq")
    curves.mean = s / count
    curves.scale = np.sqrt(np.maximum(q / count - curves.mean**2, 1e-300))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = curves.keys(curves.projected(as_matrix(batch.column(1)), longest))
            for c in range(curves.curves):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c] * len(k), pa.int32()), pa.array(k[:, c])], names=["cls", "curve", "place"])

    places = materialize(classes.select("cls", "vector").mapInArrow(keys, "cls long, curve int, place long"), "places")
    # written in order; a row's number is its partition and its place there
    ordered = places.repartitionByRange("curve", "place", "cls").sortWithinPartitions("curve", "place", "cls")
    ordered = materialize(ordered.select("cls", "curve", F.monotonically_increasing_id().alias("no")), "ordered")
    part = F.shiftright("no", 33)
    sizes = sorted(ordered.groupBy(part.alias("part")).count().collect())  # one row for each partition
    before = ordered.sparkSession.createDataFrame(
        [(r["part"], done - r["count"]) for r, done in zip(sizes, accumulate(r["count"] for r in sizes), strict=True)], "part long, before long"
    )
    # each curve has every class once; a block is of one curve, and no other curve's are next to it
    at = F.col("before") + F.col("no").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("curve") * F.lit(int(count[0]))
    number = F.shiftleft(F.col("curve").cast("long"), 40) + F.floor(at / block)
    blocks = ordered.join(F.broadcast(before), part == F.col("part")).select("cls", number.alias("block"))
    blocks = materialize(blocks, "blocks")
    free(places, ordered)
    return blocks


PAIRS = "query long, cls long, score double"


def windows(classes: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``(query, cls, score)``: of each query and block that it meets, the ``k`` best classes."""

    def meet(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q, v = as_matrix(queries.column("wanted")), as_matrix(vectors.column("vector"))
        found = []
        if len(q) and len(v):
            names, of = vectors.column("cls"), queries.column("asking")
            for a in range(0, len(q), 1024):
                own = q[a : a + 1024]
                at = best(own @ v.T, k)
                found.append((of.take(pa.array(np.repeat(np.arange(a, a + len(own)), at.shape[1]))), names.take(pa.array(at.reshape(-1))), scored(own, v, at).reshape(-1)))
        if not found:
            return pa.table({"query": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        tables = [pa.table({"query": x, "cls": y, "score": pa.array(z)}) for x, y, z in found]
        return pa.concat_tables(tables)

    placed = classes.join(blocks, "cls")
    near = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("near")
    queries = placed.where("asked").select(near, F.col("cls").alias("asking"), F.col("vector").alias("wanted"))
    placed = placed.select("block", "cls", "vector")
    return queries.groupBy("near").cogroup(placed.groupBy("block")).applyInArrow(meet, PAIRS)


def true_neighbours(classes: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """``(query, cls)``: the ``k`` best other classes of a bounded sample of queries, by comparing all."""
    held = sample.select("cls", "vector").collect()
    names, matrix = [r["cls"] for r in held], np.array([r["vector"] for r in held], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = as_matrix(batch.column(1))
            at = best(matrix @ v.T, k + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n for n in names for _ in range(at.shape[1])], pa.int64()),
                    batch.column(0).take(pa.array(at.reshape(-1))),
                    pa.array(scored(matrix, v, at).reshape(-1)),
                ],
                names=["query", "cls", "score"],
            )

    pairs = classes.select("cls", "vector").mapInArrow(run, PAIRS).where("query <> cls")
    no = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))
    return pairs.withColumn("no", no).where(F.col("no") <= k).select("query", "cls")


def best_classes(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` best classes of each query, its own among them."""
    once = pairs.groupBy("query", "cls").agg(F.max("score").alias("score"))
    no = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))
    return once.withColumn("no", no).where(F.col("no") <= k + 1).drop("no")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    curves: int = CURVES,
    axes: int = AXES,
    bits: int = BITS,
    block: int = BLOCK,
    recall: float = RECALL,
    sample: int = SAMPLE,
    seed: int = 0,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product found for each query row.

    ``is_query`` is a condition on the id, as column ``vec_id``.  Rows take part if their id
    isn't null and their vector is not null or zero, holds no null or non-finite
    component, and has the length that most vectors have (of as frequent ones
    the smaller).  Rows repeated with id and vector count once; of an id's
    different vectors, the least in array order counts.  A row isn't its own neighbour.
    Equal scores rank by the smaller id; equal vectors always all come in that
    order.  Queries with fewer than ``k`` candidates get them all; an empty
    table gives no rows; other columns are ignored.

    Every vector is placed on every curve.  Rounds of ``curves`` curves are added
    until ``sample`` queries at most (the only part that is sampled), whose true
    neighbours are searched among all vectors, find ``recall`` of them.
    """
    if axes * bits > 63:
        raise ValueError("a curve's places have 63 bits at most")
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].alias("vector"))
    classes, members, size = vector_classes(rows, k, F.coalesce(is_query, F.lit(False)))
    longest = classes.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] or 0.0
    probe = classes.where("asked").orderBy(F.xxhash64("cls"), "cls").limit(sample)
    truth = materialize(true_neighbours(classes, probe, k), "truth") if not probe.isEmpty() else None
    found, number = None, 0
    while True:
        blocks = blocks_of(classes, Curves(seed + number, size, curves, axes, bits), longest, block)
        pairs = windows(classes, blocks, k + 1)
        merged = materialize(best_classes(pairs if found is None else found.union(pairs), k), "neighbours")
        free(*(x for x in (blocks, found) if x is not None))
        found, number = merged, number + 1
        if truth is None:
            break
        want, got = truth.count(), truth.join(found, ["query", "cls"]).count()
        if got >= math.ceil(recall * want):
            break
    # a class stands for its members, as a query's k best are among the k + 1 smallest ids of its classes
    no = Window.partitionBy("cls").orderBy("vec_id")
    few = members.select("cls", "vec_id").withColumn("no", F.row_number().over(no)).where(F.col("no") <= k + 1).drop("no")
    near = found.join(few, "cls").select("query", "score", "vec_id")
    no = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("no", F.row_number().over(no)).where(F.col("no") <= k + 1).select("query", "score", "vec_id")
    own = members.where("query").select(F.col("cls").alias("query"), F.col("vec_id").alias("query_id"))
    out = near.join(own, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
