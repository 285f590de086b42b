"""Connected components over narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import free, materialize


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` by star contraction.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a
    ``groupBy`` with map-side combining over narrow rows; the number of rounds
    grows with the logarithm of the size.  Returns ``(node, component)``, the
    component being its smallest node; nodes without edges don't appear.
    No list of neighbours is ever built, so a hub doesn't hurt.
    """
    cur = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = _fingerprint(cur)
    while state[0]:
        # large star: strictly larger neighbours are linked to the least of the closed neighbourhood
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node itself, are linked to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        last, cur, before = cur, materialize(small, "edges"), state
        free(last)
        state = _fingerprint(cur)
        if state == before:
            break
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.union(roots).distinct()


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node``, ``component``) after more links ``(a, b)``, as a written table.

    Components are contracted to their names, so only the ends of the new links take part.
    """
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    ends = ends.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = connected(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = materialize(merged.select("node", F.col("component").alias("top")), "merged")
    old = labels.join(merged.select(F.col("node").alias("component"), "top"), "component", "left")
    old = old.select("node", F.coalesce("top", "component").alias("component"))
    new = merged.join(labels, "node", "left_anti").select("node", F.col("top").alias("component"))
    return materialize(old.union(new), "labels")


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and two sums of hashes of them: equal for equal sets, whatever their order."""
    hashes = (F.xxhash64("u", "v").cast("decimal(20,0)"), F.xxhash64(F.lit(1), "v", "u").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), *map(F.sum, hashes)).first())
