"""Alignment of two tokenizers' tokens by the byte offsets where tokens of both end.

A whole slice of documents is laid out as one string of bytes.  One bincount of
the A tokens' ends and one of the B tokens' ends tell where both occur, and the
text is cut there; running sums over the slice, read at the documents' bounds,
give each document's counts.

How many documents hold an id pair linked is counted in two steps: each slice
sums up its own documents, then slices are added by pair.  The counts go back to
the slices that hold the pair, not to every document, so that a pair that all
documents hold is one row a slice.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import materialize

from .bpe_count import byte_letters
from .common import WHITE, Memory, table, tokenizer_path

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of one slice (a longer text alone); pieces of text whose ids a worker remembers; links that are listed at once.
SLICE_BYTES, REMEMBERED, LINKS = 2_000_000, 300_000, 4_000_000
#: Pieces that A encodes as one text.
TOGETHER = 64
#: The mark that stands for a space in B's pieces.
SPACE = "▁"


@functools.cache
def patterns():
    """What makes it harder to cut a text at spaces, and where such a text can be cut.

    A cut is before spaces that follow another letter than white space and that
    aren't at the text's end.  A's pre-tokens end there, and B's pieces don't
    cross, as :class:`Tokens` checks.
    """
    import regex

    return re.compile(f"[{WHITE}] | $"), regex.compile(f"(?<=[^{WHITE}])(?= +[^ ])")


def padded(names: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of equal width, and their lengths."""
    size = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in names), dtype=np.uint8).reshape(-1, width), size


class Tokens:
    """Both tokenizers, with what a worker remembers of the texts' pieces."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letter = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        of_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            of_a[i] = b"".join(letter.get(c, c.encode()) for c in t)
        of_b = []
        crossing = False
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            crossing |= SPACE in piece.lstrip(SPACE)
            of_b.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.whole_texts = crossing
        self.size_a, self.size_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (of_a, of_b))
        self.bytes_a, self.bytes_b = of_a, of_b
        self.names, self.name_size = padded([str(i).encode() for i in range(max(len(of_a), len(of_b)))], 8)
        self.seen = Memory(REMEMBERED)

    def cut(self, text: str) -> list[str]:
        """Parts of space+text, each without the space that it begins with."""
        if self.whole_texts:
            return [text]
        odd, bounds = patterns()
        if text[:1] == " " or odd.search(text):
            return [x[1:] for x in bounds.split(" " + text)]
        return text.split(" ")

    def learn(self, pieces: list[str]) -> None:
        """Remember the pieces' ids, of those that can stand in one text many at a time."""
        joined, alone = [], []
        for x in pieces:
            (alone if not x or x[-1].isspace() else joined).append(x)
        for group, size in ((joined, TOGETHER), (alone, 1)):
            texts = ["".join([" " + x for x in group[i : i + size]]) for i in range(0, len(group), size)]
            ids = np.array(list(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False))), dtype=np.int64)
            # where in the ids the pieces end
            ends = np.cumsum(np.fromiter((len(x.encode()) + 1 for x in group), dtype=np.int64, count=len(group)))
            bounds_a = np.searchsorted(np.cumsum(self.size_a[ids]), ends, side="left") + 1
            ids_b = self.b.encode(group, num_threads=1)  # which adds the space
            many = np.fromiter(map(len, ids_b), dtype=np.int64, count=len(ids_b))
            flat_b = np.array(list(chain.from_iterable(ids_b)), dtype=np.int64)
            raw_a, raw_b = ids.astype("<i4").tobytes(), flat_b.astype("<i4").tobytes()
            a = b = 0
            same = b"".join(map(self.bytes_b.__getitem__, flat_b.tolist())) == " ".join(["", *group]).encode()
            for x, end_a, end_b in zip(group, (4 * bounds_a).tolist(), (4 * np.cumsum(many)).tolist(), strict=True):
                self.seen[x] = (raw_a[a:end_a], raw_b[b:end_b])
                if not same and b"".join(map(self.bytes_b.__getitem__, flat_b[b // 4 : end_b // 4].tolist())) != b" " + x.encode():
                    self.seen[x] = None
                a, b = end_a, end_b

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of space+text by A and by B as arrays' bytes, or none if B doesn't give its bytes back (A always does)."""
        cut = [self.cut(t) for t in texts]
        new = self.seen.unknown(set().union(*cut))
        self.learn(new)
        out = []
        for own in cut:
            found = [self.seen[x] for x in own]
            out.append(None if None in found else (b"".join([x[0] for x in found]), b"".join([x[1] for x in found])))
        self.seen.forget_long(new)
        return out


_tokens: dict[tuple[str, str], Tokens] = {}


def tokens_of(a: str, b: str) -> Tokens:
    if (a, b) not in _tokens:
        _tokens[a, b] = Tokens(tokenizer_path(a), tokenizer_path(b))
    return _tokens[a, b]


class Slice:
    """The alignment of the documents of one slice."""

    def __init__(self, tokens: Tokens, texts: list[str]):
        self.tokens = tokens
        # documents without tokens take no part; the others keep their order
        whole = [False] * len(texts)
        raw_a, raw_b = [], []
        for i, (t, ids) in enumerate(zip(texts, tokens.encode(texts), strict=True)):
            if t and ids is not None:
                whole[i] = True
                raw_a.append(ids[0])
                raw_b.append(ids[1])
        self.whole = np.array(whole, dtype=bool)
        of = np.flatnonzero(self.whole)
        self.ids_a, self.ids_b = (np.frombuffer(b"".join(x), dtype="<i4").astype(np.int64) for x in (raw_a, raw_b))
        many_a, many_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) // 4 for x in (raw_a, raw_b))
        # one offset scale for all documents: the running sum of token bytes, which is the same for A and B
        end_a, end_b = np.cumsum(tokens.size_a[self.ids_a]), np.cumsum(tokens.size_b[self.ids_b])
        size = int(end_a[-1]) + 1 if len(end_a) else 1
        both = (np.bincount(end_a, minlength=size) > 0) & (np.bincount(end_b, minlength=size) > 0)
        # the group of a token is the number of cuts before its last byte
        cuts = np.flatnonzero(both)
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        # documents end at cuts; sums up to a bound, less the sums up to the bound before
        last_a, last_b = np.cumsum(many_a), np.cumsum(many_b)
        self.last_group = self.group_a[last_a - 1] + 1 if len(last_a) else np.zeros(0, dtype=np.int64)
        per_doc = lambda total, at: np.diff(np.r_[0, np.r_[0, np.cumsum(total)][at]])
        links = per_doc(self.in_a * self.in_b, self.last_group)
        def spread(x):
            placed = np.zeros(len(texts), dtype=np.int64)
            placed[of] = x
            return placed

        self.n_a, self.n_b, self.n_groups, self.n_links = map(spread, (many_a, many_b, np.diff(np.r_[0, self.last_group]), links))
        self.of = of

    def digests(self) -> list[str]:
        """sha256 of each document's groups as text."""
        t = self.tokens
        begin_a, begin_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        # place of each token in the text: groups in order, a group's A tokens before its B tokens
        place_a = np.arange(len(self.ids_a)) + begin_b[self.group_a]
        place_b = np.arange(len(self.ids_b)) + (begin_a + self.in_a)[self.group_b]
        n = len(self.ids_a) + len(self.ids_b)
        ids, after = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        ids[place_a], ids[place_b] = self.ids_a, self.ids_b
        ends = np.cumsum(self.in_a + self.in_b)  # of groups
        after[ends - self.in_b - 1], after[ends - 1] = ord("|"), ord(";")
        out = [""] * len(self.whole)
        bound = 0
        tokens_end = np.r_[0, ends][self.last_group]
        for i, end in zip(self.of.tolist(), tokens_end.tolist(), strict=True):
            digest = hashlib.sha256()
            for at in range(bound, end, LINKS):
                own = ids[at : min(at + LINKS, end)]
                rows, size = t.names[own].copy(), t.name_size[own]
                rows[np.arange(len(own)), size] = after[at : at + len(own)]
                raw = rows[np.arange(8) <= size[:, None]]
                digest.update(raw[:-1] if at + len(own) == end else raw)  # no semicolon after the last group
            out[i] = digest.hexdigest()
            bound = end
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, pair, links)``: each document's distinct id pairs, A's id in the upper half, and how often it holds them linked; in order."""
        t = self.tokens
        many_b = len(t.bytes_b)
        doc_of_group = np.repeat(self.of, np.diff(np.r_[0, self.last_group]))
        width = len(t.bytes_a) * many_b
        begin_a, begin_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        links = self.in_a * self.in_b
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def add(key, n=None):
            key, at, number = np.unique(key, return_inverse=True, return_counts=True)
            keys.append(key)
            times.append(number if n is None else np.bincount(at.reshape(-1), weights=n).astype(np.int64))

        ordinary = np.flatnonzero(links <= LINKS)
        bounds = np.searchsorted(np.cumsum(links[ordinary]), np.arange(LINKS, int(links[ordinary].sum()) + LINKS, LINKS), side="left") + 1
        for own in np.split(ordinary, np.unique(np.minimum(bounds, len(ordinary)))):
            if not len(own):
                continue
            n = links[own]
            g = np.repeat(own, n)
            k = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
            a, b = self.ids_a[begin_a[g] + k // self.in_b[g]], self.ids_b[begin_b[g] + k % self.in_b[g]]
            add(doc_of_group[g] * width + a * many_b + b)
        for g in np.flatnonzero(links > LINKS).tolist():  # by the group's distinct ids, which the vocabularies bound
            a, n_a = np.unique(self.ids_a[begin_a[g] : begin_a[g] + self.in_a[g]], return_counts=True)
            b, n_b = np.unique(self.ids_b[begin_b[g] : begin_b[g] + self.in_b[g]], return_counts=True)
            add((doc_of_group[g] * width + (a[:, None] * many_b + b[None, :])).reshape(-1), np.outer(n_a, n_b).reshape(-1))
        if len(keys) > 1:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at.reshape(-1), weights=np.concatenate(times)).astype(np.int64)
        else:
            key, n = (keys[0], times[0]) if keys else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        pair = key % width
        return key // width, (pair // many_b) << 32 | pair % many_b, n


#: A slice's documents; a document's pairs by their places in the slice's sorted list.
#: The slice's first row also has that list and how many of its documents hold each pair.
ALIGNED = (
    "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary, held array<struct<pair: long, docs: int>>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """Each document's alignment, dealt into slices: what :func:`token_alignment` counts over."""

    def result(number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        s = Slice(tokens_of(a, b), texts)
        doc, pair, n = s.pairs()
        distinct, at = np.unique(pair, return_inverse=True)
        held = np.bincount(at.reshape(-1), minlength=len(distinct))
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        cut = lambda x: [x[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
        structs = pa.StructArray.from_arrays([pa.array(distinct, pa.int64()), pa.array(held, pa.int32())], names=["pair", "docs"])
        columns = {
            "slice": pa.array([number] * len(texts), pa.int64()),
            "doc_id": pa.array(ids, pa.int64()),
            "n_a": pa.array(s.n_a),
            "n_b": pa.array(s.n_b),
            "n_groups": pa.array(s.n_groups),
            "n_links": pa.array(s.n_links),
            "groups_sha256": pa.array(s.digests(), pa.string()),
            "pairs": pa.array(cut(at.reshape(-1).astype(np.int32)), pa.binary()),
            "times": pa.array(cut(n.astype(np.int32)), pa.binary()),
            "held": pa.ListArray.from_arrays(pa.array([0] + [len(distinct)] * len(texts), pa.int32()), structs),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids: list[int | None] = []
            texts: list[str] = []
            size = 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or ""
                if texts and size + len(text) > SLICE_BYTES:
                    yield result(number, ids, texts)
                    number += 1
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
            if texts:
                yield result(number, ids, texts)
                number += 1

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(held: DataFrame) -> DataFrame:
    """``(pair, docs, best)`` of all slices' ``(pair, docs)``: how many documents hold a pair linked, and whether that is its A id's highest number."""
    counts = materialize(held.groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts")
    of_a = F.shiftright("pair", 32)
    # one row for each A id: the vocabulary bounds it
    top = counts.groupBy(of_a.alias("a")).agg(F.max("docs").alias("top"))
    return counts.join(F.broadcast(top), of_a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))


def summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The results of one slice; ``counts`` has a row for each of its pairs."""
    number = lambda name: counts.column(name).to_numpy().astype(np.int64)
    order = np.argsort(number("pair"))
    docs_of, best_of = number("docs")[order], number("best")[order]
    total, n_best = [], []
    for at, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        k, n = np.frombuffer(at, dtype=np.int32), np.frombuffer(times, dtype=np.int32).astype(np.int64)
        total.append(int((docs_of[k] * n).sum()))
        n_best.append(int((best_of[k] * n).sum()))
    made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.table({n: made[n] if n in made else docs.column(n) for n in names})


def token_alignment(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row of ``docs``.

    Texts that are null or empty, or that one of the tokenizers doesn't give
    back byte for byte, have no tokens: zeros and an empty digest.  Very long
    texts are aligned whole, each in a slice of its own.  Repeated rows are each
    returned and each counted as a document; pairs that tie for an A id's
    highest count are all its best; an empty table gives no rows; other columns
    are ignored.  ``a`` is a vocabulary of the tokenizers library, ``b`` one of
    sentencepiece.
    """
    slices = materialize(aligned(docs, a, b), "aligned")
    held = slices.select(F.col("slice").alias("of"), F.explode("held").alias("h")).select("of", "h.pair", "h.docs")
    counts = held.select("of", "pair").join(pair_counts(held), "pair")
    return slices.drop("held").groupBy("slice").cogroup(counts.groupBy("of")).applyInArrow(summed, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))
