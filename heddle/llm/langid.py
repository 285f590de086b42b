"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit of the code a binary classifier on
hashed letter n-grams tells the languages whose bit is 1 from the others.  The
classifiers are log ratios of n-gram models, fitted on counts over *all*
labelled training rows, with each language weighing the same.  A text's margin
for a bit is the mean over its n-grams; decoding takes the codeword of the
least loss (Allwein et al., 2000), bits weighted by how well their classifier
separates the languages' models, and flags texts whose two best codewords are
close.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, own, table

#: Buckets of hashed n-grams (of 1 to 3 letters, with marks at word ends), bits of long codes, smoothing.
BUCKETS, LONGEST_GRAM, CODE_BITS, SMOOTHING = 1 << 14, 3, 31, 0.5
#: Share of the mean loss by which the two best codewords must differ.
AMBIGUOUS_GAP = 0.05
#: Distinct words whose n-grams a worker remembers.
REMEMBERED, SLICE = 300_000, 256


def word_list(text: str) -> list[str]:
    """Runs of letters of the lower-cased text."""
    return _letters().findall(text.lower())


def _letters():
    global _pattern
    if _pattern is None:
        import regex

        _pattern = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    return _pattern


_pattern = None


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams."""
    marked = f" {word} "
    return [
        zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS
        for n in range(1, LONGEST_GRAM + 1)
        for i in range(1 if n == 1 else 0, len(marked) - n + (n > 1))
    ]


def gram_counts(docs: DataFrame) -> dict[str, np.ndarray]:
    """Counts of n-gram buckets by language, over every row of ``(text, lang)``.

    Each task sends one row for each of its languages: an array of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(word_list(text))
            for lang, counts in words.items():
                into = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for group in _groups(counts):
                    lists = list(map(grams, group))
                    flat = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64)
                    times = np.repeat([counts[w] for w in group], list(map(len, lists)))
                    into += np.bincount(flat, weights=times, minlength=BUCKETS).astype(np.int64)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "gram", "n"]
            )

    rows = docs.select("text", docs["lang"].cast("string").alias("lang")).where("text is not null and lang is not null")
    partial = rows.mapInArrow(run, "lang string, gram int, n long")
    summed = partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("gram", "n"))).alias("grams"))
    # an array of the buckets for each language that occurs
    found = packed.select("lang", "grams").collect()
    out = {}
    for row in sorted(found, key=lambda r: r["lang"]):
        counts = np.zeros(BUCKETS)
        for g, n in row["grams"]:
            counts[g] = n
        out[row["lang"]] = counts
    return out


def _groups(words, size: int = 20_000):
    it = iter(words)
    while group := list(itertools.islice(it, size)):
        yield group


def codewords(k: int, bits: int = CODE_BITS) -> np.ndarray:
    """``k`` rows of +1 and -1.  Exhaustive up to five languages, then random rows far apart."""
    if k <= 1:
        return np.ones((k, 1), dtype=np.int8)
    if k <= 5:
        # every split of the languages in two, the first one on the +1 side
        columns = [[1] + [1 if m >> i & 1 else -1 for i in range(k - 1)] for m in range(2 ** (k - 1) - 1)]
        return np.array(columns, dtype=np.int8).T
    rng, best, most = np.random.default_rng(20), None, -1
    bits = max(bits, 4 * math.ceil(math.log2(k)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, bits))
        product = code.astype(np.int32) @ code.T
        apart = ((bits - product) // 2 + np.eye(k, dtype=np.int32) * bits).min()
        two_sided = (np.abs(code.sum(axis=0, dtype=np.int32)) < k).all()
        if two_sided and apart > most:
            best, most = code, apart
    return best


class Model:
    """Codewords, one weight for each bucket and bit, and each bit's scale and weight."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = list(counts)
        self.code = codewords(len(counts)).astype(np.float64)
        if not self.languages:
            return
        shares = np.array([(c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS) for c in counts.values()])
        if len(self.languages) == 1:
            self.weights, self.scale, self.bit_weight = np.zeros((BUCKETS, 1)), np.ones(1), np.ones(1)
            return
        plus, minus = (self.code > 0).T.astype(float), (self.code < 0).T.astype(float)
        log = np.log((plus @ shares) / plus.sum(1, keepdims=True)) - np.log((minus @ shares) / minus.sum(1, keepdims=True))
        expected = shares @ log.T  # margin of each language's own text, by bit
        right = expected * self.code
        self.scale = np.maximum(np.abs(expected).mean(axis=0), 1e-9)
        self.weights = (log / self.scale[:, None]).T
        # a bit whose classifier separates its worst language well counts for more
        self.bit_weight = np.clip(right.min(axis=0) / self.scale, 0.05, None)
        self.bit_weight /= self.bit_weight.sum()

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its probability-like score, and whether it is ambiguous."""
        loss = (np.logaddexp(0.0, -2.0 * margins[:, None, :] * self.code[None]) * self.bit_weight).sum(axis=2)
        best = loss.argmin(axis=1)
        low = loss.min(axis=1)
        odds = np.exp(-4.0 * (loss - low[:, None]))
        score = 1.0 / odds.sum(axis=1)
        if len(self.languages) == 1:
            return best, score, np.zeros(len(best), dtype=bool)
        second = np.partition(loss, 1, axis=1)[:, 1]
        return best, score, second - low < AMBIGUOUS_GAP * loss.mean(axis=1)


class Predictor:
    """Margins of texts as sums over their words, each word's being remembered."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.table = np.zeros((4096, model.weights.shape[1] + 1), dtype=np.float64) if model.languages else None

    def learn(self, new: list[str]) -> None:
        need = len(self.index) + len(new)
        while need > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        for group in _groups(new, 10_000):
            lists = list(map(grams, group))
            flat = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64)
            sizes = np.fromiter(map(len, lists), dtype=np.int64)
            sums = np.add.reduceat(self.model.weights[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
            at = len(self.index)
            self.table[at : at + len(group), :-1] = sums
            self.table[at : at + len(group), -1] = sizes
            self.index.update(zip(group, range(at, at + len(group)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        words = [word_list(t) if t else [] for t in texts]
        n = len(texts)
        if not self.model.languages:
            return ["und"] * n, [0.0] * n, [True] * n
        if len(self.index) > REMEMBERED:
            self.index.clear()
        self.learn(list(set().union(*words).difference(self.index)))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        sums = np.zeros((n, self.table.shape[1]))
        filled = np.flatnonzero(sizes)
        if len(filled):
            at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
            starts = np.r_[0, np.cumsum(sizes[filled])[:-1]]
            sums[filled] = np.add.reduceat(self.table[at], starts, axis=0)
        best, score, unsure = self.model.decode(sums[:, :-1] / np.maximum(sums[:, -1:], 1))
        lang = [self.model.languages[b] if s else "und" for b, s in zip(best, sizes, strict=True)]
        return lang, np.where(sizes > 0, score, 0.0).tolist(), (unsure | (sizes == 0)).tolist()


def train(docs: DataFrame) -> Model:
    """Fit on all rows of ``(text, lang)`` with both; see :func:`gram_counts`."""
    return Model(gram_counts(docs))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` and ``ambiguous``.

    Only ``text`` is looked at, whole.  A null text or one without a letter is
    ``und`` with score 0 and ambiguous; so is every text if nothing was
    learned.  Ties go to the language that sorts first.  Repeated rows and null
    ids give a row each; an empty table none.
    """
    kept = [docs[c] for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a codeword for each language, BUCKETS weights for each bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lang, score, unsure = predictor.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                    names=[*part.schema.names[:-1], "lang_pred", "score", "ambiguous"],
                )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return docs.select(*kept, docs["text"].alias("_text")).mapInArrow(run, kinds + "lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` for each document.

    Fitted on the documents that have a language and aren't held out; a
    document is held out if the CRC-32 of its id as text is 2 modulo 4 (never,
    if the id is null, which isn't learned from either).
    """
    rows = own(docs, "doc_id", "text", "lang")
    fold = crc_mod(F.col("doc_id"), 4)
    model = train(rows.where(fold != 2))
    flagged = rows.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return predict(flagged, model, ("doc_id", "held_out"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
