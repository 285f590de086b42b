"""N-gram Jaccard join by prefix filters under several token orders.

Documents with equal shingle sets are one class.  A shingle's document frequency
is counted over all classes; shingles of one class can't be shared and need go
no further, which leaves only near copies and documents made of common text.

If two sets have a Jaccard similarity of at least t, then under *any* order of
the shingles their prefixes of ``n - ceil(t n) + 1`` shingles meet.  The first
order (rarest first) makes the candidates, as far as the numbers of shingles that
each shares with any other class, from the bucket's one on, allow a link.  A candidate must also share
prefix shingles under the other orders, which go by different hashes; only what
passes all filters has its sets joined and intersected.

Shingles travel packed: sorted, in differences, with a number for the class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_components, materialize, table

WORDS, PERCENT = 5, 75
#: Token orders beyond the first one.
MORE_ORDERS = 2
#: Bytes of text and rows shingled at once; shingles and classes packed at once; shingles a bucket should have.
SLICE_BYTES, SLICE_ROWS, PACK, PACK_CLASSES, BUCKET = 1_000_000, 256, 1_500_000, 60_000, 2_000_000
#: Bits of a shingle's hash that travel.
HASH_BITS = 56

U = np.uint64
_rng = np.random.default_rng(4)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1, 2**62)) * 4 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = x ^ U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.r_[out, out * U(pow(base, len(out), 2**64))]
    return out[:n]


class Shingler:
    """Sets of hashed shingles of many texts at once."""

    def __init__(self, words: int = WORDS):
        self.k, self.up, self.down = words, np.ones(0, dtype=np.uint64), np.ones(0, dtype=np.uint64)

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes, ends)``: the sorted distinct hashes of each text, one text after the other, and where each ends."""
        data = b" ".join([*texts, b""]).lower()
        size = len(data)
        if size > len(self.up):
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        raw = np.frombuffer(data, dtype=np.uint8)
        solid = ~_WHITE[raw]
        edge = np.diff(np.r_[False, solid, False].astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # the hash of a word: its bytes' numbers times powers of a base, by differences of running sums
        run = np.r_[U(0), np.cumsum(_BYTE[raw] * self.up[:size], dtype=np.uint64)]
        word = mix((run[last] - run[first]) * self.down[first]) if len(first) else np.zeros(0, dtype=np.uint64)
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        owner = np.searchsorted(text_ends, first, side="right")
        counts = np.bincount(owner, minlength=len(texts))
        k, n = self.k, len(word)
        if n >= k:
            gram = word[: n - k + 1].copy()
            for i in range(1, k):
                gram = gram * U(0x2545F4914F6CDD1D) + word[i : n - k + 1 + i]
            whole = owner[: n - k + 1] == owner[k - 1 :]
            gram, of = mix(gram[whole], k), owner[: n - k + 1][whole]
        else:
            gram, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        begins = np.cumsum(counts) - counts
        extra, extra_of = [], []
        for i in np.flatnonzero((counts > 0) & (counts < k)):  # the whole sequence is the only shingle
            acc = 0
            for h in word[begins[i] : begins[i] + counts[i]].tolist():
                acc = (acc * 0x2545F4914F6CDD1D + h) & 0xFFFFFFFFFFFFFFFF
            extra.append(acc ^ (int(counts[i]) << 48))
            extra_of.append(i)
        if extra:
            gram, of = np.r_[gram, mix(np.array(extra, dtype=np.uint64), k + 1)], np.r_[of, np.array(extra_of)]
        order = np.lexsort((gram, of))
        gram, of = gram[order], of[order]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])] if len(gram) else np.zeros(0, dtype=bool)
        return gram[new], np.cumsum(np.bincount(of[new], minlength=len(texts)))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of a batch, in slices of bounded text."""
    for begin in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(begin, SLICE_ROWS)
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_BYTES):
                size += len(texts[to])
                to += 1
            yield part.column(0).slice(at, to - at), texts[at:to]
            at = to


def _classes_of(hashes: np.ndarray, ends: np.ndarray) -> list[int | None]:
    """The number of each set's class: a digest of its hashes; None for the empty set."""
    out, a = [], 0
    for b in ends.tolist():
        out.append(int.from_bytes(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else None)
        a = b
    return out


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, class, n_shingles)`` for each row of ``(doc_id, text)``; the class is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for ids, texts in _slices(batch):
                hashes, ends = shingler.sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(_classes_of(hashes, ends), pa.int64()), pa.array(np.diff(np.r_[0, ends]), pa.int64())],
                    names=["doc_id", "class", "n_shingles"],
                )

    return docs.mapInArrow(run, "doc_id long, class long, n_shingles long")


def _pack(hashes: np.ndarray, index: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Sorted hashes in differences, with the place of each one's class in ``classes``, whose sets have ``sizes``."""
    gaps = np.diff(np.r_[U(0), hashes])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    head = np.array([len(hashes), len(classes), width], dtype="<u4").tobytes()
    narrow = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return head + classes.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + index.astype("<u2").tobytes() + narrow.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k, width = np.frombuffer(data, dtype="<u4", count=3).tolist()
    classes = np.frombuffer(data, dtype="<i8", count=k, offset=12)
    sizes = np.frombuffer(data, dtype="<u4", count=k, offset=12 + 8 * k)
    index = np.frombuffer(data, dtype="<u2", count=n, offset=12 + 12 * k)
    gaps = np.zeros((n, 8), dtype=np.uint8)
    gaps[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=12 + 12 * k + 2 * n).reshape(n, width)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), classes[index], sizes[index]


def _postings(docs: DataFrame, buckets: int, words: int) -> DataFrame:
    """``(bucket, packed)``: the shingles of each class that a task meets, once a task, by ranges of the hash."""
    shift = HASH_BITS - (buckets.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        classes: list[int] = []

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate(parts) >> U(64 - HASH_BITS)
            index = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, index = hashes[order], index[order]
            known, counts = np.array(classes, dtype=np.int64), np.array(sizes, dtype=np.int64)
            cuts = np.searchsorted(hashes, np.arange(buckets + 1, dtype=np.uint64) << U(shift))
            rows = []
            for b, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
                if j > i:
                    there, place = np.unique(index[i:j], return_inverse=True)
                    rows.append((b, _pack(hashes[i:j], place, known[there], counts[there])))
            parts.clear(), sizes.clear(), classes.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "packed"]
            )

        n = 0
        for batch in batches:
            for _, texts in _slices(batch):
                hashes, ends = shingler.sets(texts)
                a = 0
                for c, b in zip(_classes_of(hashes, ends), ends.tolist(), strict=True):
                    if c is not None and c not in seen:
                        seen.add(c)
                        parts.append(hashes[a:b].copy())
                        sizes.append(b - a)
                        classes.append(c)
                        n += b - a
                    a = b
                if n >= PACK or len(classes) >= PACK_CLASSES - SLICE_ROWS:
                    yield flush()
                    n = 0
        if classes:
            yield flush()

    return docs.mapInArrow(run, "bucket int, packed binary")


def _shared(buckets: int, groups: int):
    """For a bucket: the shingles that several classes have, for each group of classes.

    A row packs its classes' digests, set sizes and numbers of shingles here,
    then the shingles' ids, which are unique over all buckets, and their
    frequencies up to 255.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x) for x in group["packed"]]
        hashes, classes, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        order = np.argsort(hashes, kind="stable")
        hashes, classes, sizes = hashes[order], classes[order], sizes[order]
        # what occurs once can't be shared; most shingles do, so the rest takes little memory
        same = hashes[1:] == hashes[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        hashes, classes, sizes = hashes[several], classes[several], sizes[several]
        # several tasks may have met one class
        order = np.lexsort((classes, hashes))
        hashes, classes, sizes = hashes[order], classes[order], sizes[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (classes[1:] != classes[:-1])][: len(hashes)]
        hashes, classes, sizes = hashes[new], classes[new], sizes[new]
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
        df = np.diff(np.r_[starts, len(hashes)])
        keep = np.repeat(df > 1, df)
        token = (np.repeat(np.cumsum(df > 1) - 1, df)[keep] * buckets + key[0]).astype(np.uint64)
        often, classes, sizes = np.repeat(np.minimum(df, 255), df)[keep].astype(np.uint8), classes[keep], sizes[keep]
        rows = []
        to = (classes.view(np.uint64) % U(groups)).astype(np.int64)
        order = np.lexsort((token, classes, to))
        token, often, classes, sizes, to = token[order], often[order], classes[order], sizes[order], to[order]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
            first = np.flatnonzero(np.r_[True, classes[a + 1 : b] != classes[a : b - 1]])
            rows.append((int(to[a]), _pack_group(classes[a:b][first], sizes[a:b][first], np.diff(np.r_[first, b - a]), token[a:b], often[a:b])))
        return pd.DataFrame(rows, columns=["grp", "packed"])

    return run


def _pack_group(classes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, token: np.ndarray, often: np.ndarray) -> bytes:
    width = 4 if token.max() < 2**32 else 8
    head = np.array([len(classes), len(token), width], dtype="<u4").tobytes()
    return head + classes.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + token.astype(f"<u{width}").tobytes() + often.tobytes()


def _unpack_group(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, set size, id and frequency of each shingle."""
    k, n, width = np.frombuffer(data, dtype="<u4", count=3).tolist()
    classes = np.frombuffer(data, dtype="<i8", count=k, offset=12)
    sizes = np.frombuffer(data, dtype="<u4", count=k, offset=12 + 8 * k)
    counts = np.frombuffer(data, dtype="<u4", count=k, offset=12 + 12 * k)
    token = np.frombuffer(data, dtype=f"<u{width}", count=n, offset=12 + 16 * k).astype(np.uint64)
    often = np.frombuffer(data, dtype=np.uint8, offset=12 + 16 * k + width * n)
    return np.repeat(classes, counts), np.repeat(sizes, counts), token, often


def _read(k: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // k}", count=k)


def _prefix(ids: np.ndarray, often: np.ndarray, n: int, percent: int, order: int) -> np.ndarray:
    """The shared shingles among the first ``n - ceil(t n) + 1`` of a set.

    Shingles of one class come first in every order, and match nothing.  The
    first order then goes by frequency, the others by hashes of their own.
    """
    take = len(ids) + 1 - -(-percent * n // 100)
    if take <= 0:
        return ids[:0]
    hashed = mix(ids, order)
    rank = np.lexsort((hashed, often)) if order == 1 else np.argsort(hashed, kind="stable")
    return ids[rank[:take]]


def _gathered(percent: int):
    """For a group of classes: those that can have a link, with their shared shingles and their prefixes under each order."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack_group(x) for x in group["packed"]]
        classes, sizes, token, often = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        order = np.lexsort((token, classes))
        classes, sizes, token, often = classes[order], sizes[order], token[order], often[order]
        cuts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
        rows = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(classes)], strict=True):
            n = int(sizes[a])
            if (b - a) * 100 < n * percent:  # a link needs ceil(t n) shared shingles
                continue
            ids = token[a:b]
            prefixes = [_prefix(ids, often[a:b], n, percent, o).astype(np.int64) for o in range(1, 2 + MORE_ORDERS)]
            kind = "<u4" if ids[-1] < 2**32 else "<u8"
            rows.append((int(classes[a]), n, b - a, ids.astype(kind).tobytes(), prefixes[0], prefixes[1:]))
        return pd.DataFrame(rows, columns=["class", "n", "k", "data", "prefix", "others"])

    return run


def candidates(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``(class, n, k, data, prefix, others)`` for the classes that can have a link, as a written table."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, 1 << max(0, int(total / BUCKET)).bit_length())
    found = _postings(docs, buckets, words).groupBy("bucket").applyInPandas(_shared(buckets, buckets), "grp int, packed binary")
    kinds = "class long, n long, k long, data binary, prefix array<long>, others array<array<long>>"
    return materialize(found.groupBy("grp").applyInPandas(_gathered(percent), kinds), "jaccard-sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes that are linked: prefixes that meet under all other orders, then the sets themselves."""

    def joined(of: DataFrame, *columns: str) -> DataFrame:
        for name in ("a", "b"):
            of = of.join(sets.select(F.col("class").alias(name), F.struct(*columns).alias(f"set_{name}")), name)
        return of

    meet = F.lit(True)
    for o in range(MORE_ORDERS):
        meet &= F.arrays_overlap(F.col("set_a.others")[o], F.col("set_b.others")[o])
    passed = materialize(joined(pairs, "others").where(meet).select("a", "b"), "jaccard-passed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                common = len(np.intersect1d(_read(one["k"], one["data"]), _read(two["k"], two["data"]), assume_unique=True))
                good.append(100 * common >= percent * (one["n"] + two["n"] - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    both = joined(passed, "n", "k", "data").select("a", "b", "set_a", "set_b")
    return materialize(both.mapInArrow(run, "a long, b long"), "jaccard-links")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Words are runs of other characters than ASCII white space, with A to Z in
    lower case.  Two documents link when 100 * |intersection| >= percent *
    |union| of their shingle sets; ``component_id`` is the smallest id that is
    reachable by links.  Null and empty texts have the empty set and link with
    nothing, not even each other.  Texts of fewer than ``words`` words have
    their whole sequence as one shingle.  Copies, and repeated rows, have equal
    sets and link.  Very long texts are shingled whole.  Null ids count as larger than all others.  An empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    members = materialize(shingle_sets(rows, words), "shingle-sets")
    classes = members.where("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("least"))
    classes = materialize(classes, "classes")
    sets = candidates(rows, classes, words, percent)

    def near(x: str, y: str) -> Column:
        # in the bucket of the first prefix shingle that both have, the intersection is among what each shares from there on
        return F.least(f"{x}.rest", f"{y}.rest") * (100 + percent) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent

    keyed = sets.select(F.posexplode("prefix").alias("pos", "key"), F.col("class").alias("node"), "n", "k")
    # an original shares more of its shingles than its copies do, and links with more of them: a good hub
    rank = (F.col("k") / F.col("n")).alias("rank")
    keyed = materialize(keyed.select("key", "node", rank, "n", (F.col("k") - F.col("pos")).alias("rest")), "prefixes")
    labels = bucket_components(keyed, near, lambda pairs: _verify(pairs, sets, percent))
    linked = labels.join(classes, labels["node"] == classes["class"]).select("class", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("class", "component_id")
    named = classes.join(named, "class", "left").select("class", F.coalesce("component_id", "least").alias("component_id"))
    return members.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
