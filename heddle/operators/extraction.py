"""Extraction with a cache by content, validation, and entity resolution."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.operators import vector_blocks
from heddle.schemas import ENTITY_TYPES, EXTRACTION, RELATION_TYPES, SIMILARITY_THRESHOLD


def parse_extraction(payload: Column) -> Column:
    """JSON to a typed extraction; missing descriptions become empty."""
    parsed = F.from_json(payload, EXTRACTION)
    entities = F.transform(
        parsed["entities"],
        lambda e: F.struct(e["name"].alias("name"), e["entity_type"].alias("entity_type"), F.coalesce(e["description"], F.lit("")).alias("description")),
    )
    return F.struct(entities.alias("entities"), parsed["relations"].alias("relations"))


def is_valid(extraction: Column) -> Column:
    """All types known, and both ends of each relation among the entities."""
    entities = F.coalesce(extraction["entities"], F.array().cast("array<struct<name:string,entity_type:string,description:string>>"))
    relations = F.coalesce(extraction["relations"], F.array().cast("array<struct<source:string,relation_type:string,target:string>>"))
    names = F.transform(entities, lambda e: e["name"])
    return F.forall(entities, lambda e: e["entity_type"].isin(*ENTITY_TYPES)) & F.forall(
        relations,
        lambda r: r["relation_type"].isin(*RELATION_TYPES) & F.array_contains(names, r["source"]) & F.array_contains(names, r["target"]),
    )


def rule_extraction(text: Column) -> Column:
    """Default of the extraction seam: capitalised words of five letters or more, typed by a hash of the word."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][a-z]{4,}"), F.lit(0)))
    kinds = F.array(*(F.lit(t) for t in ENTITY_TYPES))

    def entity(w: Column) -> Column:
        at = F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % len(ENTITY_TYPES)
        return F.struct(w.alias("name"), F.get(kinds, at).alias("entity_type"), F.lit("").alias("description"))

    return F.transform(words, entity)


def rule_relations(entities: Column) -> Column:
    """Relations of the same default: each entity with the next one, typed by a hash of both names."""
    kinds = F.array(*(F.lit(t) for t in RELATION_TYPES))

    def relation(i: Column) -> Column:
        a, b = F.get(entities, i)["name"], F.get(entities, i + 1)["name"]
        at = F.conv(F.substring(F.md5(F.concat(a, b)), 1, 4), 16, 10).cast("int") % len(RELATION_TYPES)
        return F.struct(a.alias("source"), F.get(kinds, at).alias("relation_type"), b.alias("target"))

    places = F.when(F.size(entities) > 1, F.sequence(F.lit(0), F.size(entities) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, relation)


def extract_missing(chunks: DataFrame, cache: DataFrame, extract: Callable[[Column], Column] = rule_extraction) -> DataFrame:
    """``(content_hash, entities)`` of contents that the cache lacks: each content once."""
    hashed = chunks.select(X.sha256_hex(F.col("text")).alias("content_hash"), "text")
    missing = hashed.join(cache.select("content_hash"), "content_hash", "left_anti")
    once = missing.groupBy("content_hash").agg(F.first("text").alias("text"))
    return once.select("content_hash", extract(F.col("text")).alias("entities"))


def cached_extractions(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Entities of chunks by their content's hash; chunks without a cache row are left out."""
    hashed = chunks.select("chunk_id", "doc_id", X.sha256_hex(F.col("text")).alias("content_hash"))
    return hashed.join(cache, "content_hash").select("chunk_id", "doc_id", F.explode("entities").alias("e")).select("chunk_id", "doc_id", "e.*")


def group_exact(candidates: DataFrame) -> DataFrame:
    """Candidates ``(pos, name, entity_type)`` by normalised name and type: the first name is canonical."""
    return (
        candidates.withColumn("key", X.normalize_name(F.col("name")))
        .groupBy("key", "entity_type")
        .agg(F.min(F.struct("pos", "name")).alias("first"), F.count("*").alias("n_mentions"), F.collect_set("name").alias("names"))
        .select("key", "entity_type", F.col("first.pos").alias("pos"), F.col("first.name").alias("canonical_name"), "n_mentions", F.sort_array("names").alias("source_names"))
    )


def match_exact(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """Groups take the name of an existing entity of the same key; of several the last one (by ``pos``)."""
    known = existing.groupBy(X.normalize_name(F.col("name")).alias("key"), "entity_type").agg(F.max_by("name", "pos").alias("existing_name"))
    joined = groups.join(known, ["key", "entity_type"], "left")
    return joined.withColumn("is_new", F.col("existing_name").isNull()).withColumn("canonical_name", F.coalesce("existing_name", "canonical_name")).drop("existing_name")


def match_similar(unmatched: DataFrame, existing: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """The best existing entity of the same type for each of ``(pos, entity_type, embedding)``, from the threshold on.

    All of a type are compared, by matrix products in blocks of bounded size;
    each task keeps a group's best.  Of equal scores the first existing one (by
    ``pos``, unique in its type) wins; vectors of different lengths are similar to none.
    """
    asked = unmatched.select(F.col("pos").alias("query_id"), "entity_type", "embedding")
    own = existing.select(F.col("pos").alias("id"), "entity_type", "embedding")
    near = vector_blocks.compared(asked, own, lambda q, v, order: vector_blocks.best(q, v, order, 1, threshold), ("entity_type",))
    best = near.groupBy("query_id", "entity_type").agg(F.min(F.struct((-F.col("score")).alias("loss"), "id")).alias("b"))
    best = best.select(F.col("query_id").alias("pos"), "entity_type", F.col("b.id").alias("existing_pos"), (-F.col("b.loss") + 0.0).alias("score"))
    names = existing.select("entity_type", F.col("name").alias("existing_name"), F.col("pos").alias("existing_pos"))
    return best.join(names, ["entity_type", "existing_pos"]).select("pos", "entity_type", "existing_name", "score")


def absorb_greedily(unmatched: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """``(pos, entity_type, leader_pos)``: in order, a group joins the first earlier leader that is similar.

    Not a transitive closure: later groups are compared with leaders only, so
    the order matters and each type runs in sequence.  Leaders are compared by
    matrix products, block by block.
    """
    import numpy as np

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        v = np.array(group["embedding"].tolist(), dtype=np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        leaders = np.zeros((0, v.shape[1]))
        where: list[int] = []
        out = []
        for i in range(len(v)):
            near = np.flatnonzero(leaders[: len(where)] @ v[i] >= threshold) if where else []
            if len(near):
                out.append(where[near[0]])
                continue
            if len(where) == len(leaders):
                leaders = np.vstack([leaders, np.zeros((max(64, len(leaders)), v.shape[1]))])
            leaders[len(where)] = v[i]
            where.append(i)
            out.append(i)
        pos = group["pos"].to_numpy()
        return pd.DataFrame({"pos": pos, "entity_type": group["entity_type"], "leader_pos": pos[np.array(out, dtype=int)]})

    return unmatched.select("pos", "entity_type", "embedding").groupBy("entity_type").applyInPandas(run, "pos long, entity_type string, leader_pos long")
