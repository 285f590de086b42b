"""The stored index of stems, against texts read word by word."""

import itertools
import re

import pytest

from heddle.functions.stemmer import porter
from heddle.operators import text_index


def words_of(text):
    return re.findall("[a-z]+", (text or "").lower())


def score(text, stems):
    """Sum over shortest spans that hold all stems: one over one more than the words between that aren't needed."""
    at = [(i, porter(w)) for i, w in enumerate(words_of(text)) if w not in text_index.STOP_WORDS]
    hits = [(i, s) for i, s in at if s in stems]
    spans = {}
    for k, (end, _) in enumerate(hits):
        last = {}
        for i, s in hits[: k + 1]:
            last[s] = i
        if len(last) == len(stems):
            spans.setdefault(min(last.values()), end)
    return round(sum(1 / (2 - len(stems) + e - b) for b, e in spans.items()), 6) if spans else None


TEXTS = [
    (1, "The risks of assessing a risk: assessments assess risky risk"), (2, "Controls and control"), (3, None), (4, ""), (5, "the and of"),
    (6, "Risk control " * 50), (7, "assess the very old risk"), (8, "RISKS, assessment."), (None, "risk assess"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "id long, text string, stem string, pos int")
    return text_index.write_text_index(table, f"file://{tmp_path_factory.mktemp('text-index')}")


@pytest.mark.parametrize("question", ["risk", "Assess the RISKS!", "controlling risk", "risk zebra", "risk risk"])
def test_search_like_word_by_word(index, question):
    stems = text_index.question_stems(question)
    want = {i: s for i, t in TEXTS if i is not None and (s := score(t, stems)) is not None}
    got = text_index.search_chunks(index, question, 20).collect()
    assert {r["id"]: r["score"] for r in got} == want
    order = sorted(want, key=lambda i: (-want[i], i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == order


@pytest.mark.parametrize("question", ["what is the", "", None, "!? 12"])
def test_nothing_asked_finds_nothing(index, question):
    assert text_index.question_stems(question) == []
    assert text_index.search_chunks(index, question, 5).count() == 0


def test_only_the_stems_parts_are_read(index):
    found = index.of_stems(["risk"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "risk" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert {r["id"] for r in found.collect()} == {1, 6, 7, 8}


def test_statistics(index):
    got = {r["stem"]: (r["n_docs"], r["n_occurrences"]) for r in index.statistics().collect()}
    counts = {}
    for i, t in TEXTS:
        for w in words_of(t) if i is not None else []:
            if w not in text_index.STOP_WORDS:
                counts.setdefault(porter(w), []).append(i)
    assert got == {s: (len(set(ids)), len(ids)) for s, ids in counts.items()}


def test_given_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = text_index.write_text_index(docs.selectExpr("doc_id as id", "text"), f"file://{tmp_path}")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    common = sorted(index.statistics().collect(), key=lambda r: (-r["n_docs"], r["stem"]))[:3]
    for a, b in itertools.combinations([r["stem"] for r in common], 2):
        if porter(a) != a or porter(b) != b:
            continue
        want = {i: s for i, t in rows if (s := score(t, [a, b])) is not None}
        assert {r["id"]: r["score"] for r in text_index.search_chunks(index, f"the {a} of {b}", 10_000).collect()} == pytest.approx(want)
