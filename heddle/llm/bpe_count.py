"""Token counts by rank-synchronous merging of ragged numpy arrays.

Pre-tokens that a worker hasn't met yet are laid side by side in one flat array
of symbol ids.  Each round looks up the rank of every adjacent pair, finds each
pre-token's lowest rank by a segmented minimum, and merges all its pairs of
that rank at once (left to right where they overlap); the symbols that survive
are counted.  Merging all pairs of the lowest rank at once equals merging them
one by one, as a merge only creates pairs of later ranks.

Long words are first cut where no token can cross; what is still long is merged
alone, with ranks looked up again only where a symbol changed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Cutter, Memory, chunk_pattern, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: The pattern of the vocabulary's byte-level pre-tokenizer.  Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 1024
#: Pieces of text whose counts a worker remembers, and the symbols of one round of merging.
REMEMBERED, ROUND_SYMBOLS = 400_000, 1_000_000
#: Words of more bytes are cut; parts of more bytes are merged alone.
LONG = 200
SLICE = 256


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The ranks of a vocabulary, looked up by pairs of symbol ids."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.byte_id = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(PATTERN)
        self.none = len(keys)
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.tokens = [bytes(map(letters.__getitem__, t)) for t in vocab if all(c in letters for c in t)]
        self.cutter: Cutter | None = None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the sorted table of each pair; ``none`` where there is no merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none), at

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        if max(map(len, words), default=0) <= LONG:
            return self.together(words)
        self.cutter = self.cutter or Cutter(self.tokens)
        out = np.zeros(len(words), dtype=np.int64)
        parts: list[bytes] = []
        of: list[int] = []
        for i, w in enumerate(words):
            for part in self.cutter.cut(w) if len(w) > LONG else (w,):
                if len(part) > LONG:
                    out[i] += self.alone(part)
                else:
                    parts.append(part)
                    of.append(i)
        np.add.at(out, of, self.together(parts))
        return out

    def alone(self, word: bytes) -> int:
        """Surviving symbols of one long word."""
        symbols = self.byte_id[np.frombuffer(word, dtype=np.uint8)]
        rank, at = self.rank_of(symbols[:-1], symbols[1:])
        while len(rank) and (least := rank.min()) < self.none:
            hit = np.flatnonzero(rank == least)
            # of overlapping pairs in a row, every other one from the left
            begins = np.r_[True, np.diff(hit) > 1]
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            symbols[hit] = self.made[at[hit[0]]]
            symbols, rank, at = np.delete(symbols, hit + 1), np.delete(rank, hit), np.delete(at, hit)
            new = hit - np.arange(len(hit))  # places of the made symbols; their pairs to both sides change
            pairs = np.unique(np.r_[new - 1, new])
            pairs = pairs[(pairs >= 0) & (pairs < len(rank))]
            rank[pairs], at[pairs] = self.rank_of(symbols[pairs], symbols[pairs + 1])
        return len(symbols)

    def together(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word, all words merged at once."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = lengths.copy()
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            rank, at = self.rank_of(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = self.none
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(np.r_[rank, self.none], starts)
            alive = least < self.none
            if not alive.any():
                break
            sizes = np.diff(np.r_[starts, len(owner)])
            hit = np.r_[(rank == np.repeat(least, sizes)[:-1]) & (rank < self.none), False]
            # of overlapping pairs in a row (a a a), every other one from the left
            begins = hit & ~np.r_[False, hit[:-1]]
            if hit.sum() > begins.sum():
                place = np.arange(len(hit))
                since = place - np.maximum.accumulate(np.where(begins, place, 0))
                hit &= since % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = self.made[at[where]]
            keep = np.repeat(alive, sizes)  # words without a merge left are done
            out -= np.bincount(owner[where], minlength=len(words))
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


class Counter:
    """Counts tokens of texts, remembering a bounded number of pieces."""

    def __init__(self, path: str):
        self.merges, self.seen = Merges(path), Memory(REMEMBERED)

    def learn(self, pieces: Iterable[str]) -> dict[str, int]:
        """Counts of the given pieces, in rounds of bounded size."""
        found: dict[str, int] = {}
        group: list[str] = []
        words: list[bytes] = []
        sizes: list[int] = []
        n = 0

        def flush():
            counts = self.merges.counts(words)
            ends = np.cumsum(np.array(sizes))
            totals = np.r_[0, np.cumsum(counts)][np.r_[0, ends]]
            found.update(zip(group, np.diff(totals).tolist(), strict=True))

        for piece in pieces:
            own = [w.encode("utf-8", "surrogatepass") for w in self.merges.words.findall(piece)]
            group.append(piece)
            words += own
            sizes.append(len(own))
            n += sum(map(len, own))
            if n > ROUND_SYMBOLS:
                flush()
                group, words, sizes, n = [], [], [], 0
        if group:
            flush()
        return found

    def count(self, texts: list[str]) -> list[int]:
        split, pieces_of = self.merges.split_special, chunk_pattern().findall
        out, pieces = [], []
        for t in texts:
            extra = 0
            if split is not None and any(s in t for s in self.merges.special):
                parts = split.split(t)
                extra = len(parts) - 1
                own = [p for part in parts for p in pieces_of(part)]
            else:
                own = pieces_of(t)
            out.append(extra)
            pieces.append(own)
        new = self.seen.unknown(set().union(*pieces))
        self.seen.update(self.learn(new))
        for i, own in enumerate(pieces):
            out[i] += sum(map(self.seen.__getitem__, own))
        self.seen.forget_long(new)
        return out


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``.

    Null text counts as empty: 0 bytes, 0 tokens.  Very long texts and words
    are counted whole.  Special strings inside a text are one token each.  Repeated rows are each counted; ids may be null;
    an empty table gives no rows; other columns are ignored.
    ``vocabulary`` is a file name of the public vocabularies; each worker reads
    its own machine's copy.  There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(vocabulary, None) or Counter(tokenizer_path(vocabulary))
        _counters[vocabulary] = counter
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
