"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each Python worker keeps one in-memory DuckDB database with the merge table.
The pre-tokens that it hasn't met yet become rows (word, position, symbol); a
recursive query joins neighbouring symbols with the merge table, contracts each
word's leftmost pair of the least rank, and goes on with the words that changed,
until none does.  A long word is encoded in windows that overlap by half.  A row
of ids is the encoding of its bytes if each two neighbours are the encoding of
theirs, so two windows may be joined at any place where both have a boundary and
the two ids there encode to themselves.  If some windows can't be joined, all are
made eight times as long.  Windows of more than ``LONG`` bytes take their rounds
in a table instead of a recursive query, which would hold all of them; there a
pair's later repetitions that don't overlap go with it, as they would come next
anyway.  Decoding joins a document's ids with their bytes and aggregates them in
order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Memory, chunk_pattern, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces, and as many pre-tokens, that a worker remembers; letters of pre-tokens that one recursive query gets.
REMEMBERED, QUERY_BYTES = 400_000, 500_000
#: Words of more bytes are encoded in windows; windows of more bytes take their rounds in a table.
LONG = 100
#: Bytes from one window to the next, at first, and of windows that one query gets.
STEP, WINDOW_BYTES = 48, 50_000
#: Ids that one query decodes; rows that are encoded at once.
DECODED_IDS, SLICE = 1_000_000, 512

#: Rows (word, pos, sym, nxt): nxt is the symbol at pos + 1.  The pair at (p, p + 1) is contracted into the row p + 1.
ENCODE = """
WITH RECURSIVE step(round, word, pos, sym, nxt) AS (
    SELECT 0, word, pos, sym, nxt FROM tokens
    UNION ALL
    SELECT s.round + 1, s.word, CASE WHEN s.pos > b.p THEN s.pos - 1 ELSE s.pos END,
           CASE WHEN s.pos = b.p + 1 THEN b.made ELSE s.sym END,
           CASE WHEN s.pos = b.p - 1 THEN b.made ELSE s.nxt END
    FROM step s
    JOIN (
        SELECT word, CAST(best >> 20 AS INT) AS made, CAST(best & 1048575 AS INT) AS p
        FROM (
            SELECT t.word, min((CAST(m.made AS BIGINT) << 20) | t.pos) AS best
            FROM step t JOIN merges m ON m.l = t.sym AND m.r = t.nxt
            GROUP BY t.word
        )
    ) b ON b.word = s.word
    WHERE s.pos <> b.p
)
SELECT word, sym
FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
ORDER BY word, pos
"""

#: One round of long windows: all of a word's pairs of its least rank go at once, of overlapping ones every other.
ROUND = """
SELECT word, pos, CASE WHEN take THEN made ELSE sym END AS sym, least_made IS NULL AS done
FROM (
    SELECT *, lag(take, 1, false) OVER line AS gone
    FROM (
        SELECT *, hit AND (pos_no - max(CASE WHEN hit AND NOT before THEN pos_no END) OVER line) % 2 = 0 AS take
        FROM (
            SELECT *, coalesce(made = least_made, false) AS hit,
                   coalesce(lag(made, 1) OVER line = least_made, false) AS before,
                   row_number() OVER line AS pos_no
            FROM (
                SELECT p.*, m.made, min(m.made) OVER (PARTITION BY p.word) AS least_made
                FROM (SELECT word, pos, sym, lead(sym) OVER line AS nxt FROM step WINDOW line AS (PARTITION BY word ORDER BY pos)) p
                LEFT JOIN merges m ON m.l = p.sym AND m.r = p.nxt
            ) WINDOW line AS (PARTITION BY word ORDER BY pos)
        ) WINDOW line AS (PARTITION BY word ORDER BY pos)
    ) WINDOW line AS (PARTITION BY word ORDER BY pos)
) WHERE NOT gone
"""

DECODE = """
SELECT i.seq, list(v.bytes ORDER BY i.pos) AS parts
FROM ids i JOIN vocabulary v ON v.id = i.id
GROUP BY i.seq
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes with the ranks of a vocabulary file."""

    def __init__(self, path: str):
        import duckdb
        import public_tokenizers
        import regex

        self.ranks = read_ranks(path)
        self.decimal = {r: str(r) for r in self.ranks.values()}
        self.one = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.seen, self.known = Memory(REMEMBERED), Memory(REMEMBERED)  # ids (32-bit) by piece, by pre-token
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.size = np.zeros(max(self.bytes) + 1, dtype=np.int64)
        self.size[list(self.bytes)] = list(map(len, self.bytes.values()))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        rows = [
            (self.ranks[t[:k]], self.ranks[t[k:]], r)
            for t, r in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        left, right, made = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
        self.load("merges", pa.table({"l": left, "r": right, "made": made}))
        self.load("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks, pa.binary())}))

    def load(self, name: str, rows: pa.Table) -> None:
        self.db.register("_rows", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by one recursive query, or by rounds in a table if one is longer than ``LONG``."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        sym = self.one[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(sym)) - np.repeat(ends - sizes, sizes)).astype(np.int32)
        if sizes.max() <= LONG:
            nxt = np.r_[sym[1:], np.int32(-1)]
            nxt[ends - 1] = -1
            self.db.register("tokens", pa.table({"word": word, "pos": pos, "sym": sym, "nxt": nxt}))
            found = self.db.execute(ENCODE).fetchnumpy()
            self.db.unregister("tokens")
        else:
            self.load("step", pa.table({"word": word, "pos": pos, "sym": sym}))
            self.db.execute("CREATE OR REPLACE TABLE finished (word INT, pos INT, sym INT)")
            while self.db.execute("SELECT count(*) FROM step").fetchone()[0]:
                self.db.execute(f"CREATE OR REPLACE TABLE after AS {ROUND}")
                self.db.execute("INSERT INTO finished SELECT word, pos, sym FROM after WHERE done")
                self.db.execute("CREATE OR REPLACE TABLE step AS SELECT word, pos, sym FROM after WHERE NOT done")
            found = self.db.execute("SELECT word, sym FROM finished ORDER BY word, pos").fetchnumpy()
        word, sym = np.asarray(found["word"]), np.asarray(found["sym"], dtype=np.int32)
        return np.split(sym, np.flatnonzero(word[1:] != word[:-1]) + 1)

    def contracted(self, words: list[bytes], at_once: int) -> list[np.ndarray]:
        """Ids of each word, by queries of at most ``at_once`` bytes or one word, words of like length together."""
        out: list = [None] * len(words)
        group, n = [], 0
        for j in [*sorted(range(len(words)), key=lambda j: len(words[j])), None]:
            size = 0 if j is None else len(words[j])
            if group and (j is None or n + size > at_once):
                for k, got in zip(group, self.contract([words[k] for k in group]), strict=True):
                    out[k] = got
                group, n = [], 0
            if j is not None:
                group.append(j)
                n += size
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, 32 bits each.  A word that is a token by itself is that token."""
        out: list = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) <= LONG:
                short.append(i)
            else:
                out[i] = self.encode_long(w)
        for i, got in zip(short, self.contracted([words[i] for i in short], QUERY_BYTES), strict=True):
            out[i] = got.tobytes()
        return out

    def encode_long(self, word: bytes) -> bytes:
        step = STEP
        while (found := self.joined(word, step)) is None:
            step *= 8
        return found

    def joined(self, word: bytes, step: int) -> bytes | None:
        """Ids of ``word`` from windows of ``2 * step`` bytes, one each ``step``; None if some can't be joined."""
        windows = [word[s : s + 2 * step] for s in range(0, max(len(word) - step, 1), step)]
        distinct = list(dict.fromkeys(windows))
        ids = dict(zip(distinct, self.contracted(distinct, WINDOW_BYTES), strict=True))
        # for each two windows in a row, the places where both have a boundary, from the middle of what they share:
        # the number of ids of the first before it, and of the second, at least one
        places: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        for pair in dict.fromkeys(zip(windows, windows[1:])):
            ends = np.cumsum(self.size[ids[pair[0]]]) - step
            begins = np.cumsum(self.size[ids[pair[1]]])[:-1]
            at, i, j = np.intersect1d(ends, begins, assume_unique=True, return_indices=True)
            near = np.argsort(np.abs(at - step // 2), kind="stable")
            places[pair] = list(zip((i[near] + 1).tolist(), (j[near] + 1).tolist(), strict=True))
        chosen: dict[tuple[bytes, bytes], tuple[int, int]] = {}
        rest = list(places)
        while rest:
            if any(not places[p] for p in rest):
                return None
            meet = {p: (int(ids[p[0]][places[p][0][0] - 1]), int(ids[p[1]][places[p][0][1]])) for p in rest}
            pairs = list(set(meet.values()))
            found = self.contracted([self.bytes[a] + self.bytes[b] for a, b in pairs], WINDOW_BYTES)
            fit = {p for p, got in zip(pairs, found, strict=True) if got.tolist() == list(p)}
            for p in rest:
                place = places[p].pop(0)
                if meet[p] in fit:
                    chosen[p] = place
            rest = [p for p in rest if p not in chosen]
        out, first = [], 0
        for pair in zip(windows, windows[1:]):
            end, following = chosen[pair]
            out.append(ids[pair[0]][first:end].tobytes())
            first = following
        out.append(ids[windows[-1]][first:].tobytes())
        return b"".join(out)

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """Bytes of each sequence of ids."""
        out: list[bytes] = [b""] * len(sequences)
        sizes = [len(x) for x in sequences]
        at = 0
        while at < len(sequences):
            to, n = at, 0
            while to < len(sequences) and (to == at or n + sizes[to] <= DECODED_IDS):
                n += sizes[to]
                to += 1
            flat = np.concatenate(sequences[at:to]).astype(np.int32)
            seq = np.repeat(np.arange(at, to, dtype=np.int32), sizes[at:to])
            self.db.register("ids", pa.table({"seq": seq, "pos": np.arange(len(flat)), "id": flat}))
            found = self.db.sql(DECODE).to_arrow_table().combine_chunks()
            self.db.unregister("ids")
            for part in found.to_batches():
                lists = part.column("parts")
                data = memoryview(lists.values.buffers()[2]) if len(lists.values) else b""
                starts = np.frombuffer(lists.values.buffers()[1], dtype=np.int32)[lists.values.offset :] if len(lists.values) else []
                for k, a, b in zip(part.column("seq").to_pylist(), lists.offsets[:-1].to_pylist(), lists.offsets[1:].to_pylist(), strict=True):
                    out[k] = bytes(data[starts[a] : starts[b]])
            at = to
        return out

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces, which are those of their pre-tokens in order."""
        split = list(map(self.words.findall, pieces))
        new = self.known.unknown(set().union(*split))
        self.known.update(zip(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        known = self.known.__getitem__
        self.seen.update((p, known(own[0]) if len(own) == 1 else b"".join(map(known, own))) for p, own in zip(pieces, split, strict=True))
        self.known.forget_long(new)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        pieces = list(map(chunk_pattern().findall, texts))
        new = self.seen.unknown(set().union(*pieces))
        self.learn(new)
        out = [np.frombuffer(b"".join(map(self.seen.__getitem__, own)), dtype="<i4") for own in pieces]
        self.seen.forget_long(new)
        return out


_codecs: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """This worker's codec, made once."""
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(tokenizer_path(vocabulary))
    return _codecs[vocabulary]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0), part.column(1).to_pylist()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``: the ids of each text.

    Null text counts as empty: no ids.  Texts and words of any length are
    encoded whole; beside the text, its windows and its ids, memory is bounded
    unless a word's windows can't be joined until they are long.  Ids may repeat or
    be null; every row gives a row; an empty table gives none; other columns
    are ignored.  There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _slices(batches):
            ids = codec(vocabulary).encode([t or "" for t in texts])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_ids, lists], names=["doc_id", "ids"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids decode to the empty text, bytes that are no text to replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, lists in _slices(batches):
            found = codec(vocabulary).decode([np.array(x or [], dtype=np.int32) for x in lists])
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([b.decode("utf-8", "replace") for b in found], pa.string())], names=["doc_id", "text"])

    rows = encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def encoded_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: the ids of ``encode_documents`` and what they decode to, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for doc_ids, texts in _slices(batches):
            own = codec(vocabulary)
            ids = own.encode([t or "" for t in texts])
            written = [sha(" ".join(map(own.decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
            decoded = [sha(x).hexdigest() for x in own.decode(ids)]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(list(map(len, ids)), pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
