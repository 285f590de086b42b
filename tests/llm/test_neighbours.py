"""Approximate nearest neighbours, against all inner products."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import curve_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, query int, score string, vector int"


def brute(rows, k, asked):
    """The ``k`` nearest of each query, by ids and vectors that take part."""
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for j in [j for j, i in enumerate(ids) if asked(i)]:
        s = np.einsum("ij,j->i", m, m[j])
        order = sorted((x for x in range(len(ids)) if x != j), key=lambda x: (-s[x], ids[x]))[:k]
        out[int(ids[j])] = [(int(ids[x]), float(s[x])) for x in order]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        own.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(own)
    return out


@pytest.mark.parametrize("axes, bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_curve_is_a_walk_through_all_cells(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = curve_neighbours.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = [rng.standard_normal(4).astype(np.float32).tolist() for _ in range(30)]
    fine = [(i, x) for i, x in enumerate(v)] + [(100 + i, v[3]) for i in range(40)] + [(200, [0.0, 1.0, -0.0, 0.0]), (201, [0.0, 1.0, 0.0, 0.0])]
    odd = [(300, None), (301, [0.0] * 4), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4), (305, [1.0] * 3), (306, []), (None, v[0])]
    rows = [(i, x, 0, "a", 1, "b", 2) for i, x in [*fine, *odd, fine[0], fine[0], (7, [9.0] * 4)]]
    table = spark.createDataFrame(rows, SCHEMA)
    counted = [(7, min(v[7], [9.0] * 4)) if i == 7 else (i, x) for i, x in fine]
    for k in (3, 500):
        got = results(curve_neighbours.nearest(table, F.col("vec_id") % 2 == 0, k))
        want = brute(counted, k, lambda i: i % 2 == 0)
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
        assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12) for q in want)
    assert curve_neighbours.nearest(table.where("false"), F.col("vec_id") % 2 == 0).count() == 0
    assert curve_neighbours.nearest(table.where("vec_id = 2"), F.col("vec_id") % 2 == 0).count() == 0


def test_lengths_decide_too(spark):
    """Largest inner products, not smallest angles: windows small against the table."""
    rng = np.random.default_rng(2)
    m = rng.standard_normal((3000, 12)) * rng.gamma(2, 1, (3000, 1))
    rows = [(i, x) for i, x in enumerate(m.astype(np.float32).tolist())]
    got = results(curve_neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 10, block=100))
    want = brute(rows, 10, lambda i: i % 20 == 0)
    share = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert set(got) == set(want) and share >= 0.9


def test_rounds_are_added_until_the_recall_is_met(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, x) for i, x in enumerate(rng.standard_normal((4000, 16)).astype(np.float32).tolist())]
    made = []
    plain = curve_neighbours.Curves
    monkeypatch.setattr(curve_neighbours, "Curves", lambda seed, *a: made.append(seed) or plain(seed, *a))
    got = results(curve_neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, block=150, curves=3))
    want = brute(rows, 20, lambda i: i % 20 == 0)
    share = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert len(made) > 1 and len(set(made)) == len(made) and share >= 0.9


def test_whole_table(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got, want = results(curve_neighbours.query(spark, small)), brute(rows, 20, lambda i: i % 20 == 0)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
