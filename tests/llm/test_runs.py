"""Periodic runs, against a scan of all words for every period."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from heddle.llm import periodic_runs


def brute_runs(words, least=24, times=3):
    found = {}
    for p in range(1, len(words) // times + 1):
        at = 0
        while at < len(words) - p:
            end = at
            while end < len(words) - p and words[end] == words[end + p]:
                end += 1
            if end > at and end - at + p >= max(least, times * p):
                found.setdefault((at, end + p), p)
            at = max(end, at + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(kept))


def some_words(rng):
    kinds = rng.choice([1, 2, 3, 30])
    out = []
    for _ in range(rng.randrange(8)):
        if rng.random() < 0.5:
            out += [rng.randrange(kinds) for _ in range(rng.randrange(40))]
        else:
            out += [rng.randrange(kinds) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 9)
    return out


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (5, 2)])
def test_runs_of_many_texts_at_once(least, times):
    rng = random.Random(least)
    for _ in range(300):
        texts = sorted((some_words(rng) for _ in range(rng.randrange(1, 6))), key=len, reverse=True)
        starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        flat = np.array([w for k, t in enumerate(texts) for w in [*t, -1 - k]], dtype=np.int32)
        got = [[] for _ in texts]
        for a, b, p in periodic_runs.find_runs(flat, np.array(list(map(len, texts))), least, times):
            k = int(np.searchsorted(starts, a, side="right")) - 1
            got[k].append((a - int(starts[k]), b - a, p))
        assert list(map(sorted, got)) == [brute_runs(t, least, times) for t in texts]


def test_a_text_in_parts(monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{x}" for x in some_words(rng)) + rng.choice(["", "\n", " \t"])) for i in range(60)]
    want = [brute(*d)[1:] for d in docs]
    encoded = [t.encode() for _, t in docs]
    assert periodic_runs.analyse([i for i, _ in docs], encoded) == want
    monkeypatch.setattr(periodic_runs, "SPLIT_BYTES", 10)
    assert periodic_runs.analyse([i for i, _ in docs], encoded) == want


def test_odd_rows(odd, empty, texts):
    got = Counter(tuple(r) for r in periodic_runs.periodic_runs(odd).collect())
    # the very long texts have no run of their own and too many words for the brute force
    assert got == Counter(brute(i, t) for i, t in texts if i not in (6, 7)) + Counter(r for r in got.elements() if r[0] in (6, 7))
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_very_long_runs(spark):
    unit = [f"w{i}" for i in range(977)]
    docs = [(1, "a " * 300_000), (3, " ".join((unit * 200)[:150_003])), (4, " ".join(unit * 2 + ["x"] * 23))]
    got = {r[0]: r for r in periodic_runs.periodic_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1][1:6] == (1, 0, 300_000, 1, 300_000_000)
    assert got[3][1:6] == (1, 0, 150_003, 977, 1000 * 150_003 // 977)
    assert got[3]["collapsed_sha256"] == hashlib.sha256(" ".join(unit).encode()).hexdigest()
    assert got[4]["n_runs"] == 0


def test_whole_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    short = [r for r in rows if len(r[1] or "") < 8000]
    got = Counter(tuple(r) for r in periodic_runs.query(spark, small).collect())
    assert sum(got.values()) == len(rows)
    assert not Counter(brute(*r) for r in short) - got
