"""The vector table and the communities' snapshots."""

import pytest
from pyspark.sql import functions as F

from heddle.adapters import HashEmbedder
from heddle.operators import community_job, vector_store


def state(table):
    return {r["id"]: (tuple(r["embedding"]), r["seq"]) for r in table.rows().collect()}


def test_the_last_write_stays(spark, tmp_path):
    table = vector_store.VectorTable.create(spark, f"file://{tmp_path}", 2, 8)
    rows = lambda *r: spark.createDataFrame(r, "id long, embedding array<double>, seq int, part int, last string")
    one = rows(*((i, [float(i), 0.0], 1, 0, "x") for i in range(40)), (3, [9.0, 9.0], 2, 0, "x"), (None, [1.0, 1.0], 5, 0, "x"))
    table.upsert(one, "seq")
    want = {i: ((float(i), 0.0), 1) for i in range(40)} | {3: ((9.0, 9.0), 2)}
    assert state(table) == want
    table.upsert(one, "seq")
    assert state(table) == want
    files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("vectors/part=*/*.parquet")}
    table.upsert(rows((7, [1.0, 2.0], 3, 0, "x"), (3, [0.0, 1.0], 1, 0, "x")), "seq")  # of the second an older write
    assert state(table) == want | {7: ((1.0, 2.0), 3)}
    kept = [p for p in files if p.exists()]
    assert kept and len({p.parent for p in files} - {p.parent for p in kept}) <= 2 and all(p.stat().st_mtime_ns == files[p] for p in kept)
    for wrong in ([1.0], None):
        with pytest.raises(ValueError):
            table.upsert(rows((1, [5.0, 5.0], 9, 0, "x"), (2, wrong, 9, 0, "x")), "seq")
    assert state(table) == want | {7: ((1.0, 2.0), 3)}
    table.upsert(rows(), "seq")
    with pytest.raises(ValueError):
        vector_store.VectorTable.create(spark, f"file://{tmp_path}", 3, 8)


def test_embed_stage_twice(spark, tmp_path):
    table = vector_store.VectorTable.create(spark, f"file://{tmp_path}", 8, 4, "string")
    chunks = spark.createDataFrame([("a:1", "one two"), ("a:2", "three"), ("a:3", None), (None, "x")], "chunk_id string, text string")
    vector_store.embed_chunks(chunks, table, HashEmbedder(8), 1)
    first = state(table)
    vector_store.embed_chunks(chunks, table, HashEmbedder(8), 1)
    assert state(table) == first and set(first) == {"a:1", "a:2", "a:3"}
    assert first["a:2"][0] == pytest.approx(HashEmbedder(8).embed(["three"])[0])


def test_snapshots_switch_at_once(spark, tmp_path):
    # here, as workers can't import this file
    class Failing:
        def summarize(self, text):
            raise ZeroDivisionError

    class Echo:
        def __init__(self):
            self.again = True

        def summarize(self, text):
            if self.again:
                self.again = False
                raise ValueError  # asked for once more
            return {"title": text.split("\n")[1], "summary": text}

    store = community_job.Communities(spark, f"file://{tmp_path}")
    assert store.communities().count() == 0 and store.members().count() == 0
    edges = spark.createDataFrame([("Risk", "r", "REQUIRES", "Role", "x:y")], "source_type string, source_name string, relation_type string, target_type string, target_name string")
    member = spark.createDataFrame([("Risk:r", "Risk:r"), ("Role:x:y", "Risk:r"), ("Role:z", "Role:z")], "node string, community string")
    assert store.publish(member, edges, Echo()) == (1, 1)
    want = [("Risk:r", 2, "- r (Risk)", "Entities:\n- r (Risk)\n- x:y (Role)\n\nRelations:\n- r REQUIRES x:y")]
    assert [tuple(r) for r in store.communities().collect()] == want
    assert sorted(tuple(r) for r in store.members().collect()) == [("Risk:r", "Risk", "r"), ("Risk:r", "Role", "x:y")]
    with pytest.raises(Exception, match="ZeroDivisionError"):
        store.publish(member, edges, Failing())
    assert [tuple(r) for r in store.communities().collect()] == want
    assert store.publish(member.where("community = 'Role:z'"), edges) == (0, 1)
    assert store.communities().count() == 0 and store.members().count() == 0
