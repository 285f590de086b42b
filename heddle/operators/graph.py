"""The property graph: scans, expansion, facts, upserts and upkeep.

Edges are a bag with the columns of ``schemas.EDGE_COLUMNS``; an edge is itself
by ``edge_id``.  Vertices are (type, name).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.schemas import ENTITY_TYPES, GRAPH_FACTS, MAX_HOPS, RELATION_KEY
from heddle.session import materialize

#: Keys up to which a frontier is broadcast.
BROADCAST_KEYS = 200_000


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of each edge as rows ``(entity_type, name)``, from one pass over them."""
    both = F.array(
        F.struct(F.col("source_type").alias("entity_type"), F.col("source_name").alias("name")),
        F.struct(F.col("target_type").alias("entity_type"), F.col("target_name").alias("name")),
    )
    return edges.select(F.explode(both).alias("v")).select("v.*")


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct vertices of edges."""
    return ends(edges).distinct()


def fetch_entities(vertices: DataFrame) -> DataFrame:
    return vertices.where(F.col("entity_type").isin(*ENTITY_TYPES))


def fetch_relations(edges: DataFrame) -> DataFrame:
    """All relations between entities, parallel ones included."""
    known = F.col("source_type").isin(*ENTITY_TYPES) & F.col("target_type").isin(*ENTITY_TYPES)
    return edges.where(known).select("source_type", "source_name", "relation_type", "target_type", "target_name")


def document_graph(edges: DataFrame, document_id: str) -> DataFrame:
    return edges.where(F.col("document_id") == document_id).select(
        F.struct(F.col("source_type").alias("entity_type"), F.col("source_name").alias("canonical_name")).alias("source"),
        "relation_type",
        F.struct(F.col("target_type").alias("entity_type"), F.col("target_name").alias("canonical_name")).alias("target"),
    )


def entities_for_chunks(edges: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Vertices of the edges that ``chunk_ids`` (``chunk_id``) gave rise to."""
    return endpoints(edges.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi"))


def relations_touching(edges: DataFrame, keys: DataFrame, small: bool = False) -> DataFrame:
    """Edges with an end among ``keys`` (entity_type, name), each once, in their own direction.

    ``small`` keys are broadcast and the edges read once, against both ends.
    Otherwise there are two semi joins, one for each end, instead of a join on
    a disjunction.
    """
    keys = keys.select("entity_type", "name").distinct()
    source = keys.select(F.col("entity_type").alias("source_type"), F.col("name").alias("source_name"))
    target = keys.select(F.col("entity_type").alias("target_type"), F.col("name").alias("target_name"))
    if small:
        marked = edges.join(F.broadcast(source.withColumn("_from", F.lit(True))), ["source_type", "source_name"], "left")
        marked = marked.join(F.broadcast(target.withColumn("_into", F.lit(True))), ["target_type", "target_name"], "left")
        return marked.where("_from or _into").select(*edges.columns)
    out = edges.join(source, ["source_type", "source_name"], "left_semi")
    into = edges.join(target, ["target_type", "target_name"], "left_semi").join(source, ["source_type", "source_name"], "left_anti")
    return out.unionByName(into)


def relations_by_type(edges: DataFrame, relation_type: str, key: tuple[str, str] | None = None) -> DataFrame:
    found = edges.where(F.col("relation_type") == relation_type.upper())
    if key is None:
        return found
    kind, name = key
    at_source = (F.col("source_type") == kind) & (F.col("source_name") == name)
    return found.where(at_source | ((F.col("target_type") == kind) & (F.col("target_name") == name)))


def expand_hops(
    edges: DataFrame, seeds: DataFrame, max_hops: int = MAX_HOPS, fetch: Callable[[DataFrame, DataFrame], DataFrame] | None = None, enough: int | None = None
) -> DataFrame:
    """Relations within ``max_hops`` of the seeds, with ``hop``; breadth first, one join per hop.

    A frontier holds newly seen vertices only; the walk ends early when there
    are none.  Relations are the same by ``RELATION_KEY``, the least hop counts.
    With ``enough`` it also ends after the hop that brings the relations to that
    number, so a caller that takes the first ones by hop reads no hop in vain.
    """
    seen = materialize(seeds.select("entity_type", "name").distinct(), "seen")
    frontier, found = seen, None
    for hop in range(1, max_hops + 1):
        if frontier.isEmpty():
            break
        small = frontier.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        step = (fetch or (lambda e, k: relations_touching(e, k, small)))(edges, frontier)
        step = materialize(step.withColumn("hop", F.lit(hop)), "hop")
        found = step if found is None else found.unionByName(step)
        if enough is not None and hop < max_hops and found.select(*RELATION_KEY).distinct().limit(enough).count() >= enough:
            break
        if hop < max_hops:
            frontier = materialize(endpoints(step).join(seen, ["entity_type", "name"], "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
    if found is None:
        found = edges.withColumn("hop", F.lit(0)).where("false")
    return found.groupBy(*RELATION_KEY).agg(F.min("hop").alias("hop"), F.min("document_id").alias("document_id"))


def capped_facts(expanded: DataFrame, cap: int = GRAPH_FACTS) -> DataFrame:
    """The first relations in a fixed order by hop; a top-k, not a sort."""
    return expanded.orderBy("hop", *RELATION_KEY).limit(cap)


def fact_lines(relations: DataFrame, label: Column | None = None) -> DataFrame:
    label = F.col("chunk_id").cast("string") if label is None else label
    c = F.col
    return relations.withColumn("fact", X.fact(label, c("source_type"), c("source_name"), c("relation_type"), c("target_type"), c("target_name")))


def citations(cited: DataFrame, facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations of reranked chunks ``(chunk_id, rank)`` first, then of chunks that only facts mention.

    A fact whose chunk is gone gives no citation.
    """
    graph_only = facts.select("chunk_id").distinct().join(cited, "chunk_id", "left_anti").withColumn("rank", F.lit(None).cast("int"))
    wanted = cited.select("chunk_id", "rank").unionByName(graph_only)
    return chunks.join(wanted, "chunk_id").select("chunk_id", "filename", "clause_number", "path", "rank")


def edge_weights(edges: DataFrame) -> DataFrame:
    """Mentions of each unordered vertex pair; self-loops don't count."""
    a = F.struct(F.col("source_type").alias("entity_type"), F.col("source_name").alias("name"))
    b = F.struct(F.col("target_type").alias("entity_type"), F.col("target_name").alias("name"))
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))
    return counted.select(
        F.col("a.entity_type").alias("a_type"), F.col("a.name").alias("a_name"), F.col("b.entity_type").alias("b_type"), F.col("b.name").alias("b_name"), "weight"
    )


def upsert_entities(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Vertices after a batch: a vertex keeps its first embedding; of a batch the first row counts."""
    first = new.groupBy("entity_type", "name").agg(F.min_by("embedding", "pos").alias("embedding"))
    return existing.unionByName(first.join(existing, ["entity_type", "name"], "left_anti").select(existing.columns))


class UniquenessViolated(ValueError):
    """Vertices that the graph's constraints forbid."""


def violations(vertices: DataFrame) -> DataFrame:
    """``(entity_type, name, n)`` of vertices that break a constraint: a type and name that come more than once, an unknown type, no name."""
    counted = vertices.groupBy("entity_type", "name").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") > 1) | ~_valid_key())


def _valid_key() -> Column:
    return F.coalesce(F.col("entity_type").isin(*ENTITY_TYPES) & F.col("name").isNotNull(), F.lit(False))


def require_unique(vertices: DataFrame, examples: int = 5) -> int:
    """How many vertices ``(entity_type, name)`` there are; raises :class:`UniquenessViolated` if any breaks a constraint.

    One aggregation by key, whose metrics are observed as it runs; examples are
    looked up only if it fails.
    """
    seen = Observation()
    counted = vertices.groupBy("entity_type", "name").agg(F.count("*").alias("n"))
    watched = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~_valid_key()).alias("invalid"))
    watched.write.format("noop").mode("overwrite").save()
    found = seen.get
    if found["repeated"] or found["invalid"]:
        few = [tuple(r) for r in violations(vertices).orderBy("entity_type", "name").limit(examples).collect()]
        raise UniquenessViolated(f"{found['repeated']} repeated and {found['invalid']} invalid vertices, such as {few}")
    return found["n"]


def load_edges(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions ``(source, relation_type, target, chunk_id, document_id)`` as edges between resolved names.

    ``names`` maps ``raw_name`` to ``(entity_type, canonical_name)``, one row
    each.  A mention with an unknown end is skipped; equal mentions stay parallel.
    """
    s = names.select(F.col("raw_name").alias("source"), F.col("entity_type").alias("source_type"), F.col("canonical_name").alias("source_name"))
    t = names.select(F.col("raw_name").alias("target"), F.col("entity_type").alias("target_type"), F.col("canonical_name").alias("target_name"))
    return mentions.join(s, "source").join(t, "target").select(
        "source_type", "source_name", F.upper("relation_type").alias("relation_type"), "target_type", "target_name", "chunk_id", "document_id"
    )


def drop_documents(edges: DataFrame, vertices: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without those of the documents ``gone``, and vertices that still have an edge."""
    left = edges.join(gone.select("document_id").distinct(), "document_id", "left_anti")
    return left, vertices.join(endpoints(left), ["entity_type", "name"], "left_semi")


def gap(edges: DataFrame, relation: str, covered_by: tuple[str, str], required_by: tuple[str, str]) -> DataFrame:
    """Targets that one standard maps to and another doesn't."""
    def of(key: tuple[str, str]) -> DataFrame:
        own = edges.where((F.col("relation_type") == relation) & (F.col("source_type") == key[0]) & (F.col("source_name") == key[1]))
        return own.select("target_type", "target_name").distinct()

    return of(required_by).join(of(covered_by), ["target_type", "target_name"], "left_anti")


def impact(edges: DataFrame, roots: DataFrame, max_hops: int) -> DataFrame:
    """What the roots reach along edge directions, with the least number of hops."""
    seen = roots.select("entity_type", "name", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, max_hops + 1):
        keys = frontier.select(F.col("entity_type").alias("source_type"), F.col("name").alias("source_name"))
        reached = edges.join(keys, ["source_type", "source_name"], "left_semi").select(F.col("target_type").alias("entity_type"), F.col("target_name").alias("name"))
        frontier = materialize(reached.distinct().join(seen, ["entity_type", "name"], "left_anti").withColumn("hop", F.lit(hop)), "impact")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")
