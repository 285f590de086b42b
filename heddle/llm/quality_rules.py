"""Quality rules by distribution divergence.

A document's histograms of character classes and of its language's common words
are compared with references for the language, by Jensen-Shannon distance (base
2, so from 0 to 1).  References are counted over every row of the corpus.
Short texts say little about a distribution: each comparison has a least length
below which it doesn't speak.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Words of a language's histogram, apart from one place for all others.
COMMON = 100
#: Largest distances that pass, and the least numbers of characters and of words with which they count.
CHAR_LIMIT, CHAR_GUARD = 0.26, 200
WORD_LIMIT, WORD_GUARD = 0.45, 100
#: Largest sum of both distances that passes, where both count.
SUM_LIMIT = 0.56
#: Rules of the base verdict.
LEAST_WORDS, REPEAT_SHARE = 50, 50
SYMBOLS = "#*$%&|<>"
WHITE_ASCII = " \t\n\r\x0b\x0c"
EDGE = ".,;:!?\"'()[]{}<>#*$%&|-"
REMEMBERED, SLICE = 500_000, 256

CLASSES = ("lower", "upper", "other letter", "mark", "digit", "space", "line end", "sentence mark", "bracket", "symbol", "other")


def class_of(c: str) -> int:
    kind = unicodedata.category(c)
    if c in "\n\r":
        name = "line end"
    elif c.isspace():
        name = "space"
    elif c in ".,;:!?'\"-":
        name = "sentence mark"
    elif kind in ("Ps", "Pe", "Pi", "Pf"):
        name = "bracket"
    elif kind[0] in "SP":
        name = "symbol"
    else:
        name = {"Ll": "lower", "Lu": "upper", "Nd": "digit"}.get(kind) or {"L": "other letter", "M": "mark", "N": "digit"}.get(kind[0], "other")
    return CLASSES.index(name)


_table = None


def class_counts(texts: list[str]) -> np.ndarray:
    """Characters of each class in each text."""
    global _table
    if _table is None:
        _table = np.array([class_of(chr(i)) for i in range(0x110000)], dtype=np.int8)
    k = len(CLASSES)
    out = np.zeros((len(texts), k), dtype=np.int64)
    for i, t in enumerate(texts):
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[i] = np.bincount(_table[points], minlength=k)
    return out


def bare(word: bytes) -> str:
    """The form under which a word is common."""
    return word.decode("utf-8", "surrogatepass").lower().strip(EDGE)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` from the shares ``q``; 0 for rows without counts."""
    total = p.sum(axis=-1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.where(total[..., 0] > 0, np.sqrt(np.clip(part / 2, 0, 1)), 0.0)


class References:
    """By language: shares of the character classes, the common words and their shares (the last place: all others)."""

    def __init__(self, classes: dict[str, dict[int, int]], words: dict[str, list[tuple[str, int]]], totals: dict[str, int]):
        self.languages = sorted(classes)
        self.chars, self.places, self.shares = {}, {}, {}
        for lang in self.languages:
            own_ = np.array([classes[lang].get(i, 0) for i in range(len(CLASSES))], dtype=float)
            self.chars[lang] = own_ / max(own_.sum(), 1)
            top = words.get(lang, [])
            self.places[lang] = {w: i for i, (w, _) in enumerate(top)}
            counts = np.zeros(COMMON + 1)
            counts[: len(top)] = [n for _, n in top]
            counts[COMMON] = max(0, totals.get(lang, 0) - counts.sum())
            self.shares[lang] = counts / max(counts.sum(), 1)


def references(docs: DataFrame) -> References:
    """Counted over all rows of ``(text, lang)`` that have both.  What comes to the driver grows with the number of languages only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def rows(kind, items):
            lang, key, n = zip(*items, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang), pa.array([kind] * len(lang)), pa.array(key), pa.array(n, pa.int64())], names=["lang", "kind", "key", "n"]
            )

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(0).to_pylist()
                for lang, text, n in zip(part.column(1).to_pylist(), texts, class_counts(texts), strict=True):
                    chars[lang] = chars.get(lang, 0) + n
                    words.setdefault(lang, Counter()).update(text.encode("utf-8", "surrogatepass").split())
            if sum(map(len, words.values())) > REMEMBERED:
                yield rows("word", _merged(words))
                words = {}
        if merged := _merged(words):
            yield rows("word", merged)
        if chars:
            yield rows("class", [(lang, str(i), int(x)) for lang, n in chars.items() for i, x in enumerate(n)])

    labelled = docs.select("text", docs["lang"].cast("string").alias("lang")).where("text is not null and lang is not null")
    summed = labelled.mapInArrow(run, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # read several times; as many rows as the corpus has different words
    summed = materialize(summed, "reference-counts")
    classes: dict[str, dict[int, int]] = {}
    for r in summed.where("kind = 'class'").collect():
        classes.setdefault(r["lang"], {})[int(r["key"])] = r["n"]
    of_words = summed.where("kind = 'word'")
    totals = {r["lang"]: r["n"] for r in of_words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    words: dict[str, list[tuple[str, int]]] = {}
    for r in of_words.withColumn("place", place).where(F.col("place") <= COMMON).orderBy("lang", "place").collect():
        words.setdefault(r["lang"], []).append((r["key"], r["n"]))
    return References(classes, words, totals)


def _merged(words: dict[str, Counter]) -> list[tuple[str, str, int]]:
    out: Counter = Counter()
    for lang, counts in words.items():
        for w, n in counts.items():
            if b := bare(w):
                out[lang, b] += n
    return [(lang, w, n) for (lang, w), n in out.items()]


class Scorer:
    """Base figures and distances of texts; words have numbers that a worker remembers."""

    def __init__(self, refs: References):
        self.refs, self.index = refs, {}
        self.places = {lang: np.full(4096, COMMON, dtype=np.int16) for lang in refs.languages}

    def learn(self, new: list[bytes]) -> None:
        at = len(self.index)
        forms = list(map(bare, new))
        for lang, places in self.places.items():
            while at + len(new) > len(places):
                places = np.r_[places, np.full(len(places), COMMON, dtype=np.int16)]
            get = self.refs.places[lang].get
            places[at : at + len(new)] = [get(f, COMMON) for f in forms]
            self.places[lang] = places
        self.index.update(zip(new, range(at, at + len(new)), strict=True))

    def score(self, texts: list[str], langs: list[str | None]) -> dict[str, list]:
        n = len(texts)
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.index) > REMEMBERED:
            self.index.clear()
        self.learn(list(set().union(*words).difference(self.index)))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        ids = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
        ends = np.cumsum(sizes)
        repeats = repeat_words(ids, sizes)
        classes = class_counts(texts)
        char_js, word_js, against = np.zeros(n), np.zeros(n), [None] * n
        for i in range(n):
            own_ids = ids[ends[i] - sizes[i] : ends[i]]
            candidates = [langs[i]] if langs[i] in self.places else self.refs.languages
            found = []
            for lang in candidates:
                common = np.bincount(self.places[lang][own_ids], minlength=COMMON + 1)
                w = float(distance(common, self.refs.shares[lang]))
                c = float(distance(classes[i], self.refs.chars[lang]))
                found.append((w + c, lang, c, w))
            if found:
                _, against[i], char_js[i], word_js[i] = min(found)
        lines = [[x for x in t.split("\n") if x.strip(WHITE_ASCII)] for t in texts]
        n_chars = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        base_failed = (sizes < LEAST_WORDS) | (100 * repeats > REPEAT_SHARE * sizes)
        chars_count, words_count = n_chars >= CHAR_GUARD, sizes >= WORD_GUARD
        diverges = (char_js > CHAR_LIMIT) & chars_count | (word_js > WORD_LIMIT) & words_count
        diverges |= (char_js + word_js > SUM_LIMIT) & chars_count & words_count
        return {
            "n_words": sizes.tolist(),
            "word_chars": [len(t) - sum(map(t.count, WHITE_ASCII)) for t in texts],
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": [len(x) - len(set(x)) for x in lines],
            "n_repeat_words": repeats.tolist(),
            "base_failed": base_failed.tolist(),
            "kept": (~base_failed & ~diverges).tolist(),
            "char_js": char_js.tolist(),
            "word_js": word_js.tolist(),
            "reference": against,
        }


def repeat_words(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text, its words in windows of three words that it has twice or more."""
    n, total = len(sizes), len(ids)
    owner = np.repeat(np.arange(n), sizes)
    if total < 3:
        return np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(owner[2:] == owner[:-2])
    # places of pairs of words in their sorted order are below 2 ** 31, as numbers of words are
    _, pair = np.unique(ids[at] << 31 | ids[at + 1], return_inverse=True)
    key = pair.astype(np.int64) << 31 | ids[at + 2]
    order = np.lexsort((key, owner[at]))
    same = (key[order][1:] == key[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
    windows = at[np.union1d(order[1:][same], order[:-1][same])]
    marked = np.zeros(total, dtype=bool)
    for k in range(3):
        marked[windows + k] = True
    return np.bincount(owner[marked], minlength=n)


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_js double, word_js double, reference string"
)


def judge(docs: DataFrame, refs: References | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the base figures, ``base_failed``, ``kept``, the two distances and the reference used.

    A text is compared with its language's reference or, if its language is null
    or has none, with the nearest one; without any reference the distances are
    0 and pass.  Very long texts are counted whole.  Null text has no words, so it fails the base rules, as does an
    empty one.  Repeated rows and null ids give a row each; an empty table none;
    other columns are ignored.
    """
    rows = docs.select(*(docs[c] for c in keep), docs["text"].alias("_text"), docs["lang"].cast("string").alias("_lang"))
    refs = refs or references(rows.select(F.col("_text").alias("text"), F.col("_lang").alias("lang")))
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = scorer.score([t or "" for t in part.column(part.num_columns - 2).to_pylist()], part.column(part.num_columns - 1).to_pylist())
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], *(pa.array(v, k) for v, k in zip(got.values(), kinds, strict=True))],
                    names=[*part.schema.names[:-2], *got],
                )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-2])
    return rows.mapInArrow(run, kinds + COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
