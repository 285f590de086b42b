"""Periodic run detection by harmonic grid probing.

A run of period p that is at least three periods long holds equal words at jp
and (j+1)p for at least two neighbouring grid points.  So for every period only
the grid is probed, n/p words for a text of n words and n log n for all periods
together.  What survives is extended to both sides by comparing chunks of the
word array with itself p words on, and grid points inside a found run whose
period divides p are skipped, as they would only find that run again.

Many texts are probed at once: they lie in one array, longest first, with a
separating word between them that equals no other, which no run can hold.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

LEAST, TIMES = 24, 3
#: Bytes of text that are probed at once (a longer text alone), and of a text that are split into words at once.
SLICE_BYTES, SPLIT_BYTES = 4_000_000, 1_000_000
#: Words compared first when a run is extended; each further chunk is twice as long.
CHUNK = 32
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts that are cut at white space."""
    at = 0
    while len(text) - at > SPLIT_BYTES:
        cut = WHITE.search(text, at + SPLIT_BYTES)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def repeated(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words after the repetition that the contract puts into a tenth of the documents."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return words[np.where(at < a, at, a + (at - a) % p)]


def same_ahead(words: np.ndarray, at: int, p: int, stop: int) -> int:
    """First place from ``at`` on, ``stop`` at most, whose word differs from the one p words on."""
    size = CHUNK
    while at < stop:
        end = min(at + size, stop)
        unequal = words[at:end] != words[at + p : end + p]
        k = int(unequal.argmax())
        if unequal[k]:
            return at + k
        at, size = end, 2 * size
    return stop


def same_behind(words: np.ndarray, at: int, p: int) -> int:
    """First place of the equal stretch that holds ``at``."""
    size = CHUNK
    while at > 0:
        begin = max(at - size, 0)
        unequal = (words[begin:at] != words[begin + p : at + p])[::-1]
        k = int(unequal.argmax())
        if unequal[k]:
            return at - k
        at, size = begin, 2 * size
    return 0


def find_runs(words: np.ndarray, n_of: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs ``(start, end, period)`` of texts that lie one after the other, each with a separating word at its end.

    ``n_of`` are the texts' numbers of words, descending, without the separators.
    """
    ends = np.cumsum(n_of + 1)
    known: dict[tuple[int, int], int] = {}
    #: of the run found last that covers a word: its period and its end
    period_of, end_of = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    neg = -n_of
    for p in range(1, int(n_of.max(initial=0)) // times + 1):
        texts = int(np.searchsorted(neg, -max(least, times * p), side="right"))
        if not texts:
            break
        n = int(ends[texts - 1])
        grid = words[0 : n - p : p] == words[p:n:p]
        # grid points in a row that every run of this period holds
        row = max(least - p, (times - 1) * p) // p
        good, have = grid, 1
        while have < row and len(good):
            step = min(have, row - have)
            good = good[:-step] & good[step:]
            have += step
        at = np.flatnonzero(good) * p
        for k in (1, 3, 5, 7):  # the words between two grid points of a run repeat as well
            if row < 2 or not len(at):
                break
            between = at + p * k // 8
            at = at[words[between] == words[between + p]]
        if not len(at):
            continue
        q = period_of[at]
        at = at[(q == 0) | (p % np.maximum(q, 1) != 0) | (at + p >= end_of[at])]
        over = -1
        for i in at.tolist():
            if i < over:
                continue
            over = same_ahead(words, i, p, n - p)
            end = over + p
            begin = same_behind(words, i, p)
            if end - begin >= max(least, times * p) and (begin, end) not in known:
                known[begin, end] = p
                period_of[begin:end], end_of[begin:end] = p, end
    return [(a, b, p) for (a, b), p in known.items()]


def analyse(doc_ids: list[int | None], texts: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple]:
    """For each text: number of runs, start, length, period, exponent of the longest by periods, and the two digests."""
    number: dict[bytes, int] = {}
    arrays = []
    for i, t in zip(doc_ids, texts, strict=True):
        parts = [np.array([number.setdefault(w, len(number)) for w in piece.split()], dtype=np.int32) for piece in pieces(t)]
        arrays.append(repeated(np.concatenate(parts) if len(parts) > 1 else parts[0], i))
    n_of = np.fromiter(map(len, arrays), dtype=np.int64, count=len(arrays))
    order = np.argsort(-n_of, kind="stable")
    starts = np.r_[0, np.cumsum(n_of[order] + 1)]
    flat = np.empty(int(starts[-1]), dtype=np.int32)
    for k, j in enumerate(order.tolist()):
        flat[starts[k] : starts[k + 1] - 1] = arrays[j]
        flat[starts[k + 1] - 1] = -1 - k
    runs: list[list[tuple[int, int, int]]] = [[] for _ in arrays]
    for a, b, p in find_runs(flat, n_of[order], least, times):
        k = int(np.searchsorted(starts, a, side="right")) - 1
        runs[order[k]].append((a - int(starts[k]), b - a, p))
    word = list(number)
    out = []
    for own, words in zip(runs, arrays, strict=True):
        own.sort(key=lambda r: (r[0], r[2]))
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in own)
        if own:
            best = own[0]
            for r in own[1:]:  # exact comparison of length / period
                if r[1] * best[2] > best[1] * r[2]:
                    best = r
            keep = np.ones(len(words), dtype=bool)
            for s, n, p in own:
                keep[s + p : s + n] = False
            words = words[keep]
            head = (len(own), *best, 1000 * best[1] // best[2])
        else:
            head = (0, None, None, None, None)
        digest = hashlib.sha256()
        for at in range(0, len(words), SPLIT_BYTES):
            digest.update(b" " * bool(at) + b" ".join(map(word.__getitem__, words[at : at + SPLIT_BYTES].tolist())))
        out.append((*head, hashlib.sha256(listed.encode()).hexdigest(), digest.hexdigest()))
    return out


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` for each row of ``docs``.

    A run is a maximal stretch of at least ``least`` words and ``times`` (two or
    more) of its smallest period.  Null and empty texts have no words and no
    run: four nulls and the digests of the empty string.  A null id keeps its
    text as it is.  Very long texts are searched whole, each alone.  Repeated
    rows are each returned; runs that tie in length by period go by the smaller
    start, then period; an empty table gives no rows; other columns are
    ignored.  There is no shuffle.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    types = {"string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [types.get(c.split()[1], pa.int64()) for c in SCHEMA.split(", ")]

        def result(ids, texts):
            rows = zip(*((i, *r) for i, r in zip(ids, analyse(ids, texts, least, times), strict=True)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

        for batch in batches:
            ids: list[int | None] = []
            texts: list[bytes] = []
            size = 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if texts and size + len(raw) > SLICE_BYTES:
                    yield result(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(raw)
                size += len(raw)
            if texts:
                yield result(ids, texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
