"""The vector index, against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import vector_index


def some_vectors(n, size, seed, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, size))
    m = centres[rng.integers(groups, size=n)] + 0.4 * rng.standard_normal((n, size))
    return m.astype(np.float32)


def cosines(m):
    m = m.astype(np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(m @ m.T, 6)


@pytest.fixture(scope="module")
def rows():
    return some_vectors(700, 16, 1)


@pytest.fixture(scope="module")
def table(spark, rows):
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (None, [1.0] * 16)]
    data = [(i, v, "ab"[i % 2]) for i, v in enumerate(rows.tolist())] + [(i, v, "a") for i, v in odd]
    return spark.createDataFrame(data, "id long, embedding array<float>, kind string").repartition(3)


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return vector_index.write_index(table, f"file://{tmp_path_factory.mktemp('index')}", cells=20, sample=300)


def test_every_vector_is_indexed(index, rows):
    assert index.lists.count() == len(rows)
    cells = {r["id"]: r["cell"] for r in index.lists.collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    nearest = (unit @ index.centres.T).argmax(axis=1)
    assert [cells[i] for i in range(len(rows))] == nearest.tolist()


@pytest.mark.parametrize("block", [vector_index.BLOCK, 30])
def test_near_pairs_are_all_found(index, table, rows, monkeypatch, block):
    """Also where a cell is cut into several blocks of either side."""
    monkeypatch.setattr(vector_index, "BLOCK", block)
    s = cosines(rows)
    got = {(r[0], r[1]): r[2] for r in vector_index.near_pairs(table.withColumnRenamed("id", "query_id"), index, 0.9, ("kind",)).collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.9)) if i % 2 == j % 2}
    assert set(got) == want and len(want) > 2000
    assert all(abs(got[p] - s[p]) < 2e-6 for p in got)


def test_search_by_bounds_is_exact(index, table, rows):
    queries = table.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    s = cosines(rows)
    got = {}
    for r in vector_index.search(index, queries, 12, 1, exact=True).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for q, own in got.items():
        want = sorted(range(len(rows)), key=lambda j: (-s[q, j], j))[:12]
        assert [own[k] for k in range(12)] == want
    assert len(got) == 70


def test_search_reads_only_the_probed_cells(index, table):
    one = table.where("id = 5").select(F.col("id").alias("query_id"), "embedding")
    found = vector_index.search(index, one, 5, 2)
    assert found.count() == 5
    cells = {r[0] for r in found.join(index.lists, "id").select("cell").distinct().collect()}
    assert len(cells) <= 2


def test_recall_on_the_given_vectors(spark, tmp_path):
    """Half of the cells: the vectors have no more structure than ten weak groups."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = vector_index.write_index(v, f"file://{tmp_path}")
    queries = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = {(r[0], r[1]) for r in vector_index.search(index, queries, 10, 1, exact=True).select("query_id", "id").collect()}
    got = {(r[0], r[1]) for r in vector_index.search(index, queries, 10, 32).select("query_id", "id").collect()}
    assert len(got & want) / len(want) >= 0.9


def test_nothing_to_index(spark, table, tmp_path):
    empty = vector_index.write_index(table.where("false"), f"file://{tmp_path}")
    assert vector_index.search(empty, table.select(F.col("id").alias("query_id"), "embedding"), 3, 2).count() == 0
    assert vector_index.near_pairs(table.withColumnRenamed("id", "query_id"), empty, 0.9).count() == 0
