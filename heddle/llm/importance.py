"""Quality classifier by importance resampling (Xie et al., 2023).

Two generative models over hashed n-grams, one of target text and one of the
raw corpus, give each document a log importance weight.  Gumbel noise on the
log weights makes the largest k a sample without replacement with probabilities
proportional to the weights; k follows from the share of good labels.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, own, table

BUCKETS, SMOOTHING = 10_000, 1.0
#: The target model is fitted on at most so many labelled documents, those of the least hash of the id.
TARGET_ROWS = 20_000
#: Share that stays if there are no labels.
DEFAULT_SHARE = 0.8
SEED = 20
REMEMBERED, SLICE = 600_000, 256

tokens = re.compile(r"\w+|[^\w\s]+").findall


class Grams:
    """Buckets of the uni- and bigrams of texts; words have numbers that a worker remembers."""

    def __init__(self):
        self.hashes: dict[str, int] = {}

    def buckets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams, text after text, and the number of each text's."""
        words = [tokens(t.lower()) for t in texts]
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        for w in set().union(*words).difference(self.hashes):
            self.hashes[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(texts))
        one = np.fromiter(map(self.hashes.__getitem__, itertools.chain.from_iterable(words)), dtype=np.uint64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        together = np.flatnonzero(owner[1:] == owner[:-1])
        mix = (one[together] * np.uint64(0x9E3779B97F4A7C15) + one[together + 1]) * np.uint64(0xD6E8FEB86659FD93)
        flat = np.r_[one % np.uint64(BUCKETS), (mix >> np.uint64(32)) % np.uint64(BUCKETS)].astype(np.int64)
        of = np.r_[owner, owner[together]]
        return flat, of


def fit(docs: DataFrame, target_ids: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of buckets in the target documents and in all of ``(doc_id, text)``; an array of fixed size from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, both = Grams(), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                flat, of = grams.buckets([t or "" for t in part.column(1).to_pylist()])
                good = np.array([i in shared.value for i in part.column(0).to_pylist()], dtype=bool)
                both[1] += np.bincount(flat, minlength=BUCKETS)
                both[0] += np.bincount(flat[good[of]], minlength=BUCKETS)
        at = np.flatnonzero(both[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], names=["bucket", "target", "raw"])

    shared = docs.sparkSession.sparkContext.broadcast(target_ids)
    summed = docs.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    out = np.zeros((2, BUCKETS))
    for r in summed.collect():  # at most BUCKETS rows
        out[:, r["bucket"]] = r["target"], r["raw"]
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed models; 0 everywhere without target text."""
    if not target.sum():
        return np.zeros(len(target))
    share = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * len(c))
    return np.log(share(target)) - np.log(share(raw))


def gumbel(doc_ids: list[int | None], seed: int = SEED) -> np.ndarray:
    """Noise that depends on the id and the seed only, so that a repeated task draws the same."""
    with np.errstate(over="ignore"):
        x = np.array([i or 0 for i in doc_ids], dtype=np.int64).astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def sortable(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest ``_order`` (a long), exactly; None if there are fewer.

    Four passes over 16 bits each; a pass brings at most 65,536 counts to the driver.
    """
    known, left = [], k
    for level in range(4):
        shift = 48 - 16 * level
        rows = keys
        if known:
            rows = keys.where(F.shiftright("_order", shift + 16) == F.lit(known[-1]))
        counts = rows.groupBy(F.shiftright("_order", shift).alias("digit")).count().collect()
        for digit, n in sorted(((r["digit"], r["count"]) for r in counts), reverse=True):
            if left <= n:
                known.append(digit)
                break
            left -= n
        else:
            return None
    return known[-1]


def classify(docs: DataFrame, labels: DataFrame | None, share: float | None = None, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_grams, log_weight, gumbel_key, kept)`` for each row of ``docs``.

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``; the target is what has
    quality 1 and isn't toxic.  The ``k = ceil(share * rows)`` largest keys are
    kept, ``share`` being that of quality 1 among the labels and two standard
    errors of it, so as to spare good documents, unless given; rows
    that tie with the k-th (repeated rows do) are kept too.  Null and empty
    texts have no n-grams and log weight 0.  Null ids draw the noise of id 0.
    Labels with nulls, or of documents that aren't there, have no effect.
    """
    rows = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids: set[int] = set()
    if labels is not None:
        marks = own(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null")
        good = marks.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
        ids = {r["doc_id"] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).collect()}
        if share is None:
            n, n_good = marks.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).first()
            if n:
                share = min(1.0, n_good / n + 2 * math.sqrt(n_good * (n - n_good) / n**3))
    share = DEFAULT_SHARE if share is None else share
    ratio = log_ratio(*fit(rows, ids))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = part.num_rows
                flat, of = grams.buckets([t or "" for t in part.column(1).to_pylist()])
                weight = np.bincount(of, weights=shared.value[flat], minlength=n)
                key = weight + gumbel(part.column(0).to_pylist(), seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.bincount(of, minlength=n)), pa.array(weight), pa.array(key), pa.array(sortable(key))],
                    names=["doc_id", "n_grams", "log_weight", "gumbel_key", "_order"],
                )

    scored = materialize(rows.mapInArrow(run, "doc_id long, n_grams long, log_weight double, gumbel_key double, _order long"), "weights")
    least = kth_largest(scored, math.ceil(share * scored.count()))
    kept = F.lit(True) if least is None else F.col("_order") >= F.lit(least)
    return scored.withColumn("kept", kept).drop("_order")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
