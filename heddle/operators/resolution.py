"""Entity resolution over a batch of documents, and the load of its result into the graph.

Similar names are found by matrix products over blocks of each type.  The greedy
merge, in which a group joins the first earlier group that wasn't itself merged
away, is worked out from the links alone, replayed in order in blocks of bounded
size.  No entity type, and no component, has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as X
from heddle.operators import extraction, vector_blocks
from heddle.operators.components import connected
from heddle.operators.graph import endpoints, load_edges, require_unique
from heddle.schemas import SIMILARITY_THRESHOLD
from heddle.session import free, materialize
from heddle.sources.files import exists, rewrite_parts

#: Links that one task replays; parts of the edge table by document.
REPLAY, BUCKETS = 400_000, 64

VERTICES = "entity_type string, name string, embedding array<double>"
EDGES = "source_type string, source_name string, relation_type string, target_type string, target_name string, chunk_id string, document_id string"


def replayed(links: pd.DataFrame) -> pd.DataFrame:
    """The later ends that an earlier group absorbs, and those that are ``decided`` to be."""
    absorbed: set = set(links.loc[links["decided"], "b"])
    links = links[~links["decided"]].sort_values("b", kind="stable")
    for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
        if b not in absorbed and a not in absorbed:  # all links to a come before
            absorbed.add(b)
    return pd.DataFrame({"b": list(absorbed)}, dtype=links["b"].dtype)


def absorbed_groups(links: DataFrame, replay: int = REPLAY, by: str | None = None) -> DataFrame:
    """``(b)``: the groups that don't lead, from all links ``(a, b)`` between similar groups, ``a`` before ``b``.

    A group leads if no earlier leader is linked to it; so the first group of
    each component leads, what it is linked to doesn't, and so on in order.
    Links of different ``by``, or else components, don't touch.  Each is cut, in
    order, into blocks of about ``replay`` links; a step takes the next block of
    all of them, in bins of about as many: what led before decides first, and
    then the block's own links are replayed.
    """
    kind = dict(links.dtypes)["b"]
    links = materialize(links.distinct(), "links")
    total = links.count()
    if total <= replay:  # all components fit one task
        return links.select("a", "b", F.lit(False).alias("decided")).groupBy(F.lit(0).alias("bin")).applyInPandas(lambda key, g: replayed(g), f"b {kind}")
    if by:
        part = links.withColumnRenamed(by, "component")
    else:
        part = links.join(connected(links), links["b"] == F.col("node")).select("a", "b", "component")
    counts = part.groupBy("component", "b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("component").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("component", "b", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / replay).alias("step"))
    ends = materialize(placed, "ends")
    starts = ends.select("component", F.col("b").alias("a"), F.col("step").alias("a_step"))
    part = part.join(ends.hint("merge"), ["component", "b"]).join(starts.hint("merge"), ["component", "a"], "left")
    part = materialize(part.select("component", "a", "b", "step", F.coalesce("a_step", F.lit(-1)).alias("a_step")), "placed-links")
    steps = [r[0] for r in ends.select("step").distinct().orderBy("step").collect()]  # links of the largest component by a block's
    free(links, ends)
    bin_ = F.pmod(F.xxhash64("component"), F.lit(4 * -(-total // replay))).alias("bin")
    done = None
    for step in steps:
        own = part.where(F.col("step") == step)
        inner = own.where(F.col("a_step") == step).select(bin_, "a", "b", F.lit(False).alias("decided"))
        led = own.where(F.col("a_step") < step)
        led = led if done is None else led.join(done.select(F.col("b").alias("a")).hint("merge"), "a", "left_anti")
        led = led.select(bin_, F.col("b").alias("a"), "b", F.lit(True).alias("decided")).distinct()
        gone = inner.union(led).groupBy("bin").applyInPandas(lambda key, g: replayed(g), f"b {kind}")
        last, done = done, materialize(gone if done is None else done.union(gone), "absorbed")
        if last is not None:
            free(last)
    free(part)
    return done


def greedy_leaders(links: DataFrame, replay: int = REPLAY, by: str | None = None) -> DataFrame:
    """``(pos, leader_pos)`` of the groups that are absorbed: each joins the first leader that is linked to it."""
    gone = materialize(absorbed_groups(links, replay, by), "gone")
    leading = links.join(gone.select(F.col("b").alias("a")).hint("merge"), "a", "left_anti").join(gone.hint("merge"), "b", "left_semi")
    return leading.groupBy(F.col("b").alias("pos")).agg(F.min("a").alias("leader_pos"))


def resolve_entities(
    candidates: DataFrame, existing: DataFrame, embed: Callable[[DataFrame], DataFrame], threshold: float = SIMILARITY_THRESHOLD
) -> DataFrame:
    """Candidates ``(pos, name, entity_type)`` as groups, each with the entity it becomes.

    1. Candidates of equal normalised name and type are a group, with the first
       one's name.
    2. A group takes the name of an existing entity (``entity_type``, ``name``,
       ``embedding``) of its normalised name and type; of several the largest.
    3. The others are embedded (``embed`` maps ``(pos, name)`` to ``(pos,
       embedding)``) and take the name of the most similar existing entity of
       their type from the threshold on; of equal scores the smallest name.
    4. What is left is merged greedily, in order of ``pos``.

    ``pos`` is unique and ordered, ``threshold`` is over 0.  Rows without name or
    type are no candidates.  Returns a written table ``(key, entity_type, pos,
    canonical_name, is_new, late, leader_pos, embedding)``: ``late`` is false for
    groups of step 2, ``leader_pos`` orders a merged group like its leader, and
    the embedding is the leader's, null where none was needed.
    """
    candidates = candidates.where("name is not null and entity_type is not null")
    groups = extraction.group_exact(candidates).select("key", "entity_type", "pos", "canonical_name")
    groups = materialize(extraction.match_exact(groups, existing.withColumn("pos", F.col("name"))), "groups")
    columns = ["key", "entity_type", "pos", "canonical_name", "is_new", "late", "leader_pos", "embedding"]
    exact = groups.where("not is_new").select("*", F.lit(False).alias("late"), F.col("pos").alias("leader_pos"), F.lit(None).cast("array<double>").alias("embedding"))
    fresh = groups.where("is_new")
    vectors = embed(fresh.select("pos", F.col("canonical_name").alias("name"))).select("pos", F.col("embedding").cast("array<double>").alias("embedding"))
    fresh = materialize(fresh.join(vectors, "pos"), "fresh")

    asked = fresh.select(F.col("pos").alias("query_id"), "entity_type", "embedding")
    old = existing.select(F.col("name").alias("id"), "entity_type", F.col("embedding").cast("array<double>").alias("embedding"))
    nearest = lambda q, v, order: vector_blocks.best(q, v, order, 1, threshold)
    near = vector_blocks.compared(asked, old, nearest, ("entity_type",))
    best = near.groupBy("query_id").agg(F.min_by("id", F.struct((-F.col("score")).alias("loss"), "id")).alias("existing_name"))
    merged = materialize(best.hint("merge").join(fresh, fresh["pos"] == best["query_id"]).drop("query_id"), "merged")
    rest = materialize(fresh.join(merged.select("pos").hint("merge"), "pos", "left_anti"), "rest")

    own = rest.select(F.col("pos").alias("id"), "entity_type", "embedding")
    linked = lambda q, v, order: vector_blocks.near(q, v, threshold)
    links = vector_blocks.compared(own.withColumnRenamed("id", "query_id"), own, linked, ("entity_type",), earlier=True)
    links = materialize(links.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "entity_type"), "similar")
    leaders = greedy_leaders(links, by="entity_type")
    rest = rest.join(leaders.hint("merge"), "pos", "left").withColumn("leader_pos", F.coalesce("leader_pos", "pos"))
    first = rest.where("pos = leader_pos").select("leader_pos", F.col("canonical_name").alias("leader_name"), F.col("embedding").alias("leader_embedding"))
    rest = rest.join(first.hint("merge"), "leader_pos").withColumn("canonical_name", F.col("leader_name")).withColumn("embedding", F.col("leader_embedding"))

    late = F.lit(True).alias("late")
    merged = merged.withColumn("canonical_name", F.col("existing_name")).withColumn("is_new", F.lit(False)).withColumn("leader_pos", F.col("pos"))
    out = exact.select(columns).union(merged.select("*", late).select(columns)).union(rest.select("*", late).select(columns))
    return materialize(out, "resolved")


def canonical_names(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(raw_name, entity_type, canonical_name)``: one row for each raw name, as mentions give no type.

    A name that stands for several types means its last group, those matched
    exactly coming first; a canonical name of several types is its last type's.
    """
    order = F.struct("late", "leader_pos")
    raw = candidates.select(F.col("name").alias("raw_name"), "entity_type", X.normalize_name(F.col("name")).alias("key")).distinct()
    names = raw.join(resolved.hint("merge"), ["key", "entity_type"]).groupBy("raw_name").agg(F.max_by("canonical_name", order).alias("canonical_name"))
    types = resolved.groupBy("canonical_name").agg(F.max_by("entity_type", order).alias("entity_type"))
    return names.join(types.hint("merge"), "canonical_name").select("raw_name", "entity_type", "canonical_name")


@dataclass
class StoredGraph:
    """Vertices and edges as tables in one folder; edges lie in parts by document."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _vertices(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/vertices"):
            return self.spark.createDataFrame([], f"{VERTICES}, bucket int")
        return self.spark.read.schema(f"{VERTICES}, bucket int").parquet(f"{self.path}/vertices")

    def vertices(self) -> DataFrame:
        return self._vertices().drop("bucket")

    def edges(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/edges"):
            return self.spark.createDataFrame([], f"{EDGES}, bucket int")
        return self.spark.read.schema(f"{EDGES}, bucket int").parquet(f"{self.path}/edges")

    def upsert(self, vertices: DataFrame) -> None:
        """Adds vertices whose type and name are new; a vertex keeps its first embedding."""
        new = vertices.dropDuplicates(["entity_type", "name"]).join(self.vertices(), ["entity_type", "name"], "left_anti")
        new = materialize(new.select("entity_type", "name", F.col("embedding").cast("array<double>").alias("embedding")), "new-vertices")
        self._append(new)
        free(new)

    def _append(self, vertices: DataFrame) -> None:
        placed = vertices.select("entity_type", "name", F.col("embedding").cast("array<double>").alias("embedding"), self._bucket("entity_type", "name").alias("bucket"))
        placed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/vertices")

    def create(self, vertices: DataFrame) -> None:
        """Adds vertices that must be new: fails, and adds none, if one is there already, comes twice, or has no name or no known type."""
        staged = materialize(vertices.select("entity_type", "name", "embedding"), "new-vertices")
        keys = ["entity_type", "name"]
        try:
            require_unique(staged.select(*keys).union(self.vertices().select(*keys).join(staged.select(*keys), keys, "left_semi")))
            self._append(staged)
        finally:
            free(staged)

    def drop_unused(self, vertices: DataFrame) -> None:
        """Drops those of ``vertices`` that no edge touches; only the parts that hold one of them are written again.

        Edges are read once, for their ends alone, against the asked vertices.
        """
        keys = ["entity_type", "name"]
        asked = vertices.select(*keys).distinct()
        gone = materialize(asked.join(endpoints(self.edges()), keys, "left_anti").withColumn("bucket", self._bucket(*keys)), "unused")
        touched = sorted(r[0] for r in gone.select("bucket").distinct().collect())  # at most as many as parts
        if touched:
            kept = materialize(self._vertices().where(F.col("bucket").isin(touched)).join(gone.select(*keys), keys, "left_anti"), "vertices")
            rewrite_parts(kept, f"{self.path}/vertices", "bucket", touched, "name")
            free(kept)
        free(gone)

    def edges_of(self, documents: DataFrame) -> DataFrame:
        """Edges of some documents, from their parts alone."""
        asked = documents.select("document_id").distinct()
        touched = [r[0] for r in asked.select(self._bucket("document_id")).distinct().collect()]  # at most as many as parts
        return self.edges().where(F.col("bucket").isin(touched)).join(asked, "document_id", "left_semi")

    def replace(self, documents: DataFrame, edges: DataFrame) -> None:
        """Puts ``edges`` in the place of all edges of ``documents``; edges of others aren't kept.

        Only the parts that hold one of the documents are read and written, so
        the same call twice leaves the same table, and a call that was cut off
        is repaired by repeating it.
        """
        bucket = self._bucket("document_id")
        documents = materialize(documents.select("document_id").distinct(), "documents")
        touched = sorted(r[0] for r in documents.select(bucket.alias("b")).distinct().collect())  # at most as many as parts
        names = [c.split()[0] for c in EDGES.split(", ")]
        kept = self.edges().where(F.col("bucket").isin(touched)).join(documents, "document_id", "left_anti").select(*names)
        new = edges.join(documents, "document_id", "left_semi").select(*names)
        rows = materialize(kept.union(new).withColumn("bucket", bucket), "edges")
        rewrite_parts(rows, f"{self.path}/edges", "bucket", touched, "chunk_id")
        free(rows, documents)


def resolve_and_load(
    graph: StoredGraph,
    documents: DataFrame,
    candidates: DataFrame,
    mentions: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    threshold: float = SIMILARITY_THRESHOLD,
) -> DataFrame:
    """Resolves a batch of ``documents`` against the stored graph and loads it; returns the resolved groups.

    ``candidates`` are ``(pos, name, entity_type)``, ``mentions`` relations
    ``(source, relation_type, target, chunk_id, document_id)`` by raw names.  A
    mention of a name that isn't a candidate of the batch is left out; equal
    mentions are parallel edges.  Loading a batch again replaces its documents'
    edges and adds no vertex.  All entities become vertices, with relations or not.
    """
    candidates = materialize(candidates.select("pos", "name", "entity_type"), "candidates")
    resolved = resolve_entities(candidates, graph.vertices(), embed, threshold)
    graph.upsert(resolved.where("is_new and pos = leader_pos").select("entity_type", F.col("canonical_name").alias("name"), "embedding"))
    graph.replace(documents, load_edges(mentions, canonical_names(candidates, resolved)))
    return resolved
