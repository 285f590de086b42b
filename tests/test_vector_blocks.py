"""Vectors compared in blocks, against all pairs one by one."""

import random

import numpy as np
import pytest

from heddle.operators import evaluation, extraction, resolution, search, vector_blocks


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b)) / n, 6) + 0.0 if n else 0.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(4)) for _ in range(5)], rng.choice("xyz")) for i in range(90)]
    return [*rows, (90, [1.0] * 4, "x"), (91, [2.0] * 4, "x"), (92, [0.0] * 5, "x"), (93, rows[0][1], rows[0][2])]


@pytest.mark.parametrize("numbers", [40, 10**6])
def test_like_all_pairs(spark, rows, numbers, monkeypatch):
    for name, n in (("QUERIES", numbers), ("VECTORS", numbers), ("ROWS", 7), ("COLUMNS", 11)):
        monkeypatch.setattr(vector_blocks, name, n)
    v = spark.createDataFrame([*rows, (94, None, "x"), (None, [1.0] * 5, "x")], "id long, embedding array<double>, kind string")
    q = v.withColumnRenamed("id", "query_id")
    pairs = [(a[0], b[0], cosine(a[1], b[1])) for a in rows for b in rows if a[2] == b[2] and len(a[1]) == len(b[1])]
    kernel = lambda q, v, order: vector_blocks.near(q, v, 0.8)
    got = vector_blocks.compared(q, v, kernel, ("kind",), earlier=True).collect()
    assert {(r["query_id"], r["id"], r["score"]) for r in got} == {p for p in pairs if p[0] < p[1] and p[2] >= 0.8}
    kinds = {r[0]: r[2] for r in rows}
    assert all(r["kind"] == kinds[r["id"]] for r in got) and len(got) == len({(r["query_id"], r["id"]) for r in got})


@pytest.mark.parametrize("k", [1, 3])
def test_best_with_ties(k):
    rng = np.random.default_rng(k)
    q, v = (rng.integers(-1, 2, (n, 4)).astype(float) for n in (30, 5000))  # few directions, so many ties, also across blocks
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    q, v = unit(q), unit(v)
    order = rng.permutation(len(v))
    score = np.round(q @ v.T, 6) + 0.0
    for least in (-2.0, 0.9):
        want = {(i, j) for i in range(len(q)) for j in np.lexsort((order, -score[i]))[:k] if score[i, j] >= least}
        at, to, found = vector_blocks.best(q, v, order, k, least)
        assert {(i, j) for i, j in zip(at, to, strict=True)} == want and len(at) == len(want)
        assert (found == score[at, to]).all()


def test_leaders_of_two_kinds_in_blocks(spark):
    """Each kind's links are replayed in blocks of a few links, without looking for components."""
    rng = random.Random(9)
    pairs = {k: [tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)] for k in "xy"}
    links = spark.createDataFrame([(f"{k}{a:03d}", f"{k}{b:03d}", k) for k in "xy" for a, b in pairs[k]], "a string, b string, kind string")
    want = {}
    for k in "xy":
        leader = {}
        for b in range(40):
            leader[b] = min((a for a, c in pairs[k] if c == b and leader[a] == a), default=b)
        want |= {f"{k}{b:03d}": f"{k}{a:03d}" for b, a in leader.items() if a != b}
    got = {r["pos"]: r["leader_pos"] for r in resolution.greedy_leaders(links, 25, by="kind").collect()}
    assert got == want


def test_nearest_keeps_no_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "VECTORS", 800)
    monkeypatch.setattr(vector_blocks, "QUERIES", 40)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(600, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    kept = vector_blocks.compared(q, v, lambda q, v, order: vector_blocks.best(q, v, order, 3))
    assert kept.count() <= 30 * 3 * 6  # of 30 * 600 pairs, three of each query and block
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(unit[::20] @ unit.T, 6)
    want = {(20 * i, int(j), rank) for i in range(30) for rank, j in enumerate(np.lexsort((np.arange(600), -score[i]))[:3])}
    assert {(r["query_id"], r["id"], r["rank"]) for r in search.nearest(q, v, 3).collect()} == want


def test_relevance_is_counted_by_label(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a")], "id long, label string")
    queries = spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "query_id long, label string")
    found = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (3, 1), (9, 5)], "query_id long, id long")
    got = {tuple(r) for r in evaluation.precision_recall(found, queries, labels).collect()}
    assert got == {(1, 0.5, round(2 / 3, 6)), (3, 0.0, 0.0), (9, 0.0, 0.0)}


def test_the_most_similar_of_a_type_by_products(spark):
    v = spark.createDataFrame([(i, "x" if i % 3 else "y", x.tolist()) for i, x in enumerate(np.random.default_rng(2).integers(0, 3, (80, 4)).astype(float))], "pos long, entity_type string, embedding array<double>")
    new, old = v.where("pos % 4 = 0"), v.where("pos % 4 > 0").selectExpr("concat('v', pos) AS name", "entity_type", "pos", "embedding")
    found = extraction.match_similar(new, old, 0.5)
    assert "zip_with" not in found._jdf.queryExecution().toString()  # no expression over each pair
    rows = v.collect()
    want = {}
    for a in rows:
        near = [(-cosine(a["embedding"], b["embedding"]), b["pos"]) for b in rows if a["pos"] % 4 == 0 < b["pos"] % 4 and a["entity_type"] == b["entity_type"]]
        if near and min(near)[0] <= -0.5:
            want[a["pos"]] = (a["entity_type"], f"v{min(near)[1]}", -min(near)[0])
    assert {r["pos"]: (r["entity_type"], r["existing_name"], r["score"]) for r in found.collect()} == want
