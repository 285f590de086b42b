"""Packing documents into sequences by linear grouping (de la Vega and Lueker, 1981).

Lengths are whole numbers up to the capacity, so a histogram of them, at most
``capacity`` numbers whatever the corpus, is all that planning needs:

1. large lengths, in descending order, are cut into groups of equal
   cardinality, and each group's lengths are rounded up to its largest;
2. few sizes are left, and configurations of them are chosen one after the
   other, each the fullest that the remaining counts allow, for as many
   sequences as they allow;
3. actual documents take the places of the rounded sizes;
4. the small lengths fill what is left by best fit, then new sequences.

The plan is a list of runs "items ranks r..r+n of length l go to sequences
s..s+n at offset o".  Documents get their rank among those of their length by
salted counting, and look up their run.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, materialize, table, tokenizer_path

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1
#: Lengths from this share of the capacity are large; so many groups of them.
LARGE_SHARE, GROUPS = 1 / 4, 200
REMEMBERED, LONGEST_KEY, SLICE = 600_000, 64, 1024
#: Words that are encoded as one string.
JOINED = 512
#: Rows that share a salt when documents of one length are numbered.
ROWS_A_SALT = 20_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts; words between white space are encoded once and remembered.

    The tokenizer drops white space and nothing it does crosses it, so that a
    text's ids are its words' ids in order.  Plain words are encoded many at a
    time: each pre-token ends with the one symbol that has the word-end mark,
    which tells where one plain word's ids end and the next one's begin.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for lower-case ASCII pre-tokens between blanks, to which normalisation and byte-level letters do nothing
        self.model = Tokenizer.from_file(path)
        self.model.normalizer, self.model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was remembered before ``seen`` was last emptied
        self.words = re.compile(f"[^{WHITE}]+").findall
        # texts whose lower case can't interact with normalisation or make a special string
        self.odd = re.compile("[^\x00-\u02ff]|<\\|").search
        # letters that stay letters in lower case, digits, and marks without the apostrophe of contractions
        letters, marks = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
        self.plain = re.compile(f"[{letters}0-9{marks}]+").fullmatch
        self.parts = re.compile(f"[{letters}]+|[0-9]|[{marks}]+").findall
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    def split(self, text: str) -> list[str]:
        # str.split() also splits at these four, which aren't white space for the tokenizer
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.words(text)
        # the tokenizer's own lower case, but once for all; words then repeat more often
        if text.isascii():
            return text.split() if "<|" in text else text.lower().split()
        return text.split() if self.odd(text) else text.lower().split()

    def learn(self, new: list[str]) -> None:
        """Remembers the ids of ``new`` words."""
        simple, blanked, simple_sizes, plain, sizes, odd = [], [], [], [], [], []
        for w in new:
            ascii = w.isascii() and w.islower()
            if ascii and w.isalpha():
                simple.append(w)
                blanked.append(w)
                simple_sizes.append(1)
            elif self.plain(w) and "<|" not in w:
                parts = self.parts(w)
                if ascii:
                    simple.append(w)
                    blanked += parts
                    simple_sizes.append(len(parts))
                else:
                    plain.append(w)
                    sizes.append(len(parts))
            else:
                odd.append(w)
        self._learn_joined(self.model, simple, simple_sizes, blanked)
        self._learn_joined(self.tokenizer, plain, sizes, None)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.seen[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _learn_joined(self, tokenizer, words: list[str], sizes: list[int], parts: list[str] | None) -> None:
        """Encodes ``words``, or else their ``parts``, many at a time; ``sizes`` are their numbers of pre-tokens."""
        first = 0
        for at in range(0, len(words), JOINED):
            own, counts = words[at : at + JOINED], np.cumsum(sizes[at : at + JOINED])
            joined = " ".join(own if parts is None else parts[first : first + int(counts[-1])])
            first += int(counts[-1])
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != counts[-1] or ends[-1] + 1 != len(ids):
                raise AssertionError("a plain word has other pre-tokens than expected")
            data, bounds = ids.tobytes(), [0, *(4 * (ends[counts - 1] + 1)).tolist()]
            self.seen.update((w, data[a:b]) for w, a, b in zip(own, bounds, bounds[1:], strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.split(t) for t in texts]
        if len(self.seen) > REMEMBERED:  # frequent words come back from the older ones
            self.older, self.seen = self.seen, {}
        new = set().union(*split).difference(self.seen)
        back = [w for w in new if w in self.older]
        self.seen.update((w, self.older[w]) for w in back)
        new = list(new.difference(back))
        self.learn(new)
        out = [b"".join(map(self.seen.__getitem__, own)) for own in split]
        for w in new:
            if len(w) > LONGEST_KEY:
                del self.seen[w]
        return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each text's ids and ``end_id``, cut where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(tokenizer_path(vocabulary))
        encode, end = _encoders[vocabulary].encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = part.column(0).to_pylist()
                rows = []
                for doc_id, data in zip(ids, encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    data += end
                    for k, a in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[a : a + 4 * capacity]
                        rows.append((doc_id, k, a // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each size make the fullest sequence; ``sizes`` descend.

    Bounded subset sum by bit sets; larger sizes are preferred on the way back.
    """
    reach = [1]  # reach[i]: the sums that sizes[i:] can make, built from the smallest
    mask = (1 << (capacity + 1)) - 1
    for size, count in zip(reversed(sizes), reversed(counts), strict=True):
        sums, n, step = reach[-1], min(count, capacity // size), 1
        while n:
            take = min(step, n)
            sums |= (sums << (take * size)) & mask
            n, step = n - take, step * 2
        reach.append(sums)
    reach.reverse()
    left, out = reach[0].bit_length() - 1, []
    for i, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        n = min(count, left // size)
        while n and not reach[i + 1] >> (left - n * size) & 1:
            n -= 1
        if not reach[i + 1] >> (left - n * size) & 1:
            raise AssertionError("unreachable sum")
        out.append(n)
        left -= n * size
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first_rank, n, first_sequence, offset)`` that place every item.

    ``histogram`` has the number of items of each length from 1 to ``capacity``.
    Item ``first_rank + i`` of a length goes to sequence ``first_sequence + i``.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    blocks: list[tuple[int, int, int]] = []  # (room, first sequence, sequences) that still have room
    n_seq = 0

    def place(length: int, n: int, seq: int, offset: int) -> None:
        runs.append((length, used[length], n, seq, offset))
        used[length] += n

    least = max(1, int(capacity * LARGE_SHARE))
    for length in (capacity,):
        if n := histogram.get(length, 0):
            place(length, n, 0, 0)
            n_seq = n
    large = sorted((x for x in histogram if least <= x < capacity and histogram[x]), reverse=True)
    total = sum(histogram[x] for x in large)
    # 1. groups of equal cardinality; stock: the actual lengths behind a rounded size
    each = max(1, -(-total // groups))
    stock: list[list[list[int]]] = []
    room_in_group = 0
    for x in large:
        n = histogram[x]
        while n:
            if not room_in_group:
                stock.append([])
                room_in_group = each
            take = min(n, room_in_group)
            stock[-1].append([x, take])
            n, room_in_group = n - take, room_in_group - take
    sizes = [g[0][0] for g in stock]
    counts = [sum(n for _, n in g) for g in stock]
    # 2. and 3.: configurations of rounded sizes, filled with actual lengths
    while any(counts):
        live = [i for i, n in enumerate(counts) if n]
        config = fullest([sizes[i] for i in live], [counts[i] for i in live], capacity)
        chosen = [(i, k) for i, k in zip(live, config, strict=True) if k]
        times = min(counts[i] // k for i, k in chosen)
        parts = [(n_seq, times, 0)]  # (first sequence, sequences, filled)
        for i, k in chosen:
            counts[i] -= k * times
            for _ in range(k):
                split = []
                for seq, n, filled in parts:
                    while n:
                        x, there = stock[i][-1]
                        take = min(n, there)
                        place(x, take, seq, filled)
                        split.append((seq, take, filled + x))
                        seq, n = seq + take, n - take
                        stock[i][-1][1] -= take
                        if not stock[i][-1][1]:
                            stock[i].pop()
                parts = split
        n_seq += times
        blocks += [(capacity - filled, seq, n) for seq, n, filled in parts if filled < capacity]
    # 4. best fit of the small ones, longest first
    blocks.sort()
    for x in sorted((x for x in histogram if x < least and histogram[x]), reverse=True):
        left = histogram[x]
        while left:
            at = bisect.bisect_left(blocks, (x, -1, -1))
            if at == len(blocks):
                k = capacity // x
                n = max(1, left // k)
                blocks.append((capacity, n_seq, n))
                n_seq += n
                continue
            room, seq, n = blocks.pop(at)
            take = min(n, left)
            place(x, take, seq, capacity - room)
            left -= take
            for rest in ((room - x, seq, take), (room, seq + take, n - take)):
                if rest[0] and rest[2]:
                    bisect.insort(blocks, rest)
    return runs


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: places in sequences of at most ``capacity``.

    ``items`` has ``doc_id``, ``piece``, ``start`` and a ``length`` from 1 to
    ``capacity`` for each row; it is read twice, so it should be a written table.  Rows of
    one length are numbered within salts and then across them.
    """
    n_rows = items.count()
    salts = max(16, -(-n_rows // ROWS_A_SALT))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*items.columns), F.lit(salts)).cast("int"))
    per_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = sorted(plan(histogram, capacity, groups))
    length, first, _, seq, offset = (np.array(x, dtype=np.int64) for x in (zip(*runs, strict=True) if runs else [()] * 5))
    # its size follows from the capacity and the number of groups, not from the rows
    shared = items.sparkSession.sparkContext.broadcast((length << 44 | first, first, seq, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, seq, offset = shared.value
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, n << 44 | rank, side="right") - 1
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(seq[at] + rank - first[at]), pa.array(offset[at])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    numbered = salted.withColumn("_within", F.row_number().over(within).cast("long")).join(starts, ["length", "_salt"])
    ranked = numbered.select(*items.columns, (F.col("_first") + F.col("_within") - 1).alias("_rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece of a document: ids counted, cut and placed in sequences.

    Null text counts as empty: the end id alone, one piece of length 1.  Texts
    longer than ``capacity`` are cut; their last piece may be shorter.  Repeated
    rows are packed each (their pieces share ``doc_id`` and ``piece``); null ids
    are kept; an empty table gives no rows; other columns are ignored.
    """
    return pack(materialize(pieces(docs, capacity, vocabulary), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
