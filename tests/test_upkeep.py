"""Constraints, upkeep of the stored graph from changes, and documents' status tracks."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heddle.operators import graph, resolution
from heddle.streaming import status, upkeep

VERTEX = "entity_type string, name string, embedding array<double>"
CHANGE = "document_id string, seq bigint, deleted boolean, source string, lang string, text string"


def names(store):
    return sorted((r["entity_type"], r["name"]) for r in store.vertices().collect())


def test_constraints_stop_a_load_as_a_whole(spark, tmp_path):
    store = resolution.StoredGraph(spark, f"file://{tmp_path}", 4)
    rows = lambda *r: spark.createDataFrame([(*k, [1.0]) for k in r], VERTEX)
    store.create(rows(("Control", "a"), ("Risk", "a")))  # the same name under two types is two vertices
    want = [("Control", "a"), ("Risk", "a")]
    assert names(store) == want
    for wrong in ([("Role", "b"), ("Role", "b")], [("Role", "b"), ("Risk", "a")], [("Role", None), ("Role", "b")], [("Animal", "b")], [(None, "b")]):
        with pytest.raises(graph.UniquenessViolated):
            store.create(rows(*wrong))
        assert names(store) == want
    store.create(rows())
    store.create(rows(("Role", "b")))
    assert names(store) == [("Control", "a"), ("Risk", "a"), ("Role", "b")]
    assert graph.require_unique(store.vertices()) == 3


def pairs(docs):
    """A test's extraction: each line ``x y`` is an edge."""
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("instr(line, ' ') > 0")
    word = lambda n: F.split("line", " ")[n]
    kind = F.lit("Control")
    return lines.select(kind.alias("source_type"), word(0).alias("source_name"), F.lit("REQUIRES").alias("relation_type"), kind.alias("target_type"), word(1).alias("target_name"), F.concat_ws(":", "document_id", "i").alias("chunk_id"), "document_id")


def state(store):
    return sorted((r["source_name"], r["target_name"], r["document_id"]) for r in store.edges().collect()), [n for _, n in names(store)]


def test_changes_replace_delete_and_sweep(spark, tmp_path):
    store, load = resolution.StoredGraph(spark, f"file://{tmp_path}/g", 4), upkeep.plain_load(pairs)
    batch = lambda *r: spark.createDataFrame([(d, s, gone, None, None, t) for d, s, gone, t in r], CHANGE)
    first = batch(("1", 1, False, "a b\nb c"), ("2", 1, False, "c d"), ("2", 0, False, "x y"), (None, 1, False, "n n"), ("3", None, False, "m m"), ("4", 1, False, None), ("5", 1, False, ""))
    assert upkeep.apply_changes(store, first, "one", load) == 4
    want = [("a", "b", "1"), ("b", "c", "1"), ("c", "d", "2")], ["a", "b", "c", "d"]
    assert state(store) == want
    assert upkeep.apply_changes(store, first, "one", load) == 0 and state(store) == want  # the same batch again

    second = batch(("1", 2, False, "a b"), ("2", 2, True, None))
    calls = []

    def breaks(store, documents):
        load(store, documents)
        calls.append(1)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        upkeep.apply_changes(store, second, "two", breaks)
    assert calls and upkeep.apply_changes(store, second, "two", load) == 2
    # c was touched by both documents; what the first attempt replaced is swept as well
    assert state(store) == ([("a", "b", "1")], ["a", "b"])
    late = batch(("2", 1, False, "late late"), ("1", 2, True, None))
    assert upkeep.apply_changes(store, late, "three", load) == 0
    assert state(store) == ([("a", "b", "1")], ["a", "b"])
    tie = batch(("1", 3, False, "p q"), ("1", 3, True, None))
    assert upkeep.apply_changes(store, tie, "four", load) == 1 and state(store) == ([], [])


def test_verdicts_of_the_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    news = lambda *r: spark.createDataFrame(r, status.NEWS)
    landing, before = f"{tmp_path}/news", Counter()

    def tell(*rows):
        news(*rows).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(status.NEWS).parquet(landing)
        status.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        found = spark.read.schema(status.VERDICTS).parquet(f"{tmp_path}/out").collect()
        new = Counter((r["event_id"], r["verdict"], r["status"], r["graph_status"]) for r in found) - before
        before.update(new)
        return set(new)

    # out of order within a batch: it is taken by time
    assert tell(("2", "d", "ingestion", "chunking", at(2)), ("1", "d", "ingestion", "parsing", at(1)), ("3", "d", "graph", "extracting", at(3)), (None, "d", "graph", "ready", at(3)), ("9", None, "graph", "ready", at(3))) == {
        ("1", "accepted", "parsing", "not_started"), ("2", "accepted", "chunking", "not_started"), ("3", "not ready", "chunking", "not_started"),
    }
    # a repeated, a late and an illegal one, in a later batch
    assert tell(("2", "d", "ingestion", "chunking", at(2)), ("4", "d", "ingestion", "embedding", at(1)), ("5", "d", "ingestion", "ready", at(5)), ("6", "d", "x", "ready", at(6)), ("7", "d", "ingestion", "embedding", None)) == {
        ("2", "repeated", "chunking", "not_started"), ("4", "late", "chunking", "not_started"), ("5", "illegal", "chunking", "not_started"),
        ("6", "illegal", "chunking", "not_started"), ("7", "illegal", "chunking", "not_started"),
    }
    tracks = [("8", "ingestion", "embedding"), ("10", "ingestion", "ready"), ("11", "graph", "extracting"), ("12", "graph", "failed"), ("13", "graph", "extracting"), ("14", "ingestion", "failed")]
    found = tell(*((e, "d", t, s, at(10 + i)) for i, (e, t, s) in enumerate(tracks)))
    assert ("13", "accepted", "ready", "extracting") in found and ("12", "accepted", "ready", "failed") in found and ("14", "illegal", "ready", "extracting") in found


def test_transitions_of_both_tracks():
    every = {*status.INGESTION, *status.GRAPH, "failed"}
    legal = {(a, b) for a in every for b in every if status.allowed("ingestion", a, b)}
    assert legal == {*zip(status.INGESTION, status.INGESTION[1:], strict=False), *((a, "failed") for a in status.INGESTION[:-1])}
    legal = {(a, b) for a in every for b in every if status.allowed("graph", a, b)}
    assert legal == {*((a, "extracting") for a in every), ("extracting", "extracted"), ("extracted", "resolving"), ("resolving", "ready"), *((a, "failed") for a in status.GRAPH[1:-1])}
