"""The driver's tables, and the property graph that is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Paragraphs of documents: one chunk for each line with text; ordinals count all lines."""
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("order_in_parent", "text"))
    path = F.concat_ws(".", "source", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit("p"), F.col("order_in_parent").cast("string")))
    return lines.where(F.length("text") > 0).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("order_in_parent").cast("string")).alias("chunk_id"),
        "doc_id", "order_in_parent", path.alias("path"), "source", "lang", "text",
    )


def _edges(df: DataFrame, source_type: str, source: Column, relation: str, target_type: str, target: Column, chunk: Column, document: Column, *key: Column) -> DataFrame:
    return df.select(
        F.concat_ws(":", F.lit(relation), *(k.cast("string") for k in (*key, source, target))).alias("edge_id"),
        F.lit(source_type).alias("source_type"), source.cast("string").alias("source_name"), F.lit(relation).alias("relation_type"),
        F.lit(target_type).alias("target_type"), target.cast("string").alias("target_name"),
        chunk.cast("long").alias("chunk_id"), document.cast("string").alias("document_id"),
    )


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the derived graph: a bag, with parallel edges where the tables have them."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    nation, lineitem, orders, part = t("nation"), t("lineitem"), t("orders"), t("part")
    named = nation.select("n_nationkey", "n_name")
    # nation and region have 25 and 5 rows at any scale
    of_region = nation.join(F.broadcast(t("region")), nation["n_regionkey"] == c("r_regionkey"))
    of_supplier = t("supplier").join(F.broadcast(named), c("s_nationkey") == c("n_nationkey"))
    of_customer = t("customer").join(F.broadcast(named), c("c_nationkey") == c("n_nationkey"))
    lines = lineitem.join(orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    line_key = (c("l_linenumber"), c("l_partkey"), c("l_suppkey"))
    mapped = (
        lineitem.where("l_quantity = 50").select("l_partkey", "l_suppkey")
        .join(t("supplier").select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
        .join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), c("s_nationkey") == c("n_nationkey"))
        .select("n_regionkey", "l_partkey").distinct()
    )
    parts = [
        _edges(of_region, "Clause", c("n_name"), "PART_OF", "Standard", c("r_name"), c("n_nationkey"), c("r_regionkey")),
        _edges(of_supplier, "Role", c("s_suppkey"), "PART_OF", "Clause", c("n_name"), c("s_suppkey"), c("n_nationkey")),
        _edges(of_customer, "Asset", c("c_custkey"), "PART_OF", "Clause", c("n_name"), c("c_custkey"), c("n_nationkey")),
        _edges(part, "Control", c("p_partkey"), "DEFINED_IN", "Definition", c("p_brand"), c("p_partkey"), c("p_type")),
        _edges(part, "Control", c("p_partkey"), "IS_PREREQUISITE_FOR", "Requirement", c("p_type"), c("p_partkey"), c("p_type")),
        _edges(orders, "Process", c("o_orderkey"), "APPLIES_TO", "Asset", c("o_custkey"), c("o_orderkey"), c("o_custkey")),
        _edges(lines, "Process", c("l_orderkey"), "REQUIRES", "Control", c("l_partkey"), c("l_orderkey"), c("o_custkey"), *line_key),
        _edges(lines, "Role", c("l_suppkey"), "IMPLEMENTS", "Control", c("l_partkey"), c("l_orderkey"), c("o_custkey"), c("l_orderkey"), c("l_linenumber")),
        _edges(mapped, "Standard", c("n_regionkey"), "MAPS_TO", "Control", c("l_partkey"), c("l_partkey"), c("n_regionkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same graph in SQL, as common table expressions of the oracle's queries.
STAR_SQL = """
nat AS (SELECT n_nationkey, n_name, n_regionkey FROM nation),
lines AS (SELECT l.*, o.o_custkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
edges AS (
SELECT 'PART_OF:' || n_name || ':' || r_name AS edge_id, 'Clause' AS source_type, n_name AS source_name, 'PART_OF' AS relation_type, 'Standard' AS target_type,
       r_name AS target_name, CAST(n_nationkey AS BIGINT) AS chunk_id, CAST(r_regionkey AS VARCHAR) AS document_id
FROM nat JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'PART_OF:' || s_suppkey || ':' || n_name, 'Role', CAST(s_suppkey AS VARCHAR), 'PART_OF', 'Clause', n_name, s_suppkey, CAST(n_nationkey AS VARCHAR)
FROM supplier JOIN nat ON s_nationkey = n_nationkey
UNION ALL SELECT 'PART_OF:' || c_custkey || ':' || n_name, 'Asset', CAST(c_custkey AS VARCHAR), 'PART_OF', 'Clause', n_name, c_custkey, CAST(n_nationkey AS VARCHAR)
FROM customer JOIN nat ON c_nationkey = n_nationkey
UNION ALL SELECT 'DEFINED_IN:' || p_partkey || ':' || p_brand, 'Control', CAST(p_partkey AS VARCHAR), 'DEFINED_IN', 'Definition', p_brand, p_partkey, p_type FROM part
UNION ALL SELECT 'IS_PREREQUISITE_FOR:' || p_partkey || ':' || p_type, 'Control', CAST(p_partkey AS VARCHAR), 'IS_PREREQUISITE_FOR', 'Requirement', p_type, p_partkey, p_type FROM part
UNION ALL SELECT 'APPLIES_TO:' || o_orderkey || ':' || o_custkey, 'Process', CAST(o_orderkey AS VARCHAR), 'APPLIES_TO', 'Asset', CAST(o_custkey AS VARCHAR), o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders
UNION ALL SELECT 'REQUIRES:' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_orderkey || ':' || l_partkey, 'Process', CAST(l_orderkey AS VARCHAR), 'REQUIRES', 'Control', CAST(l_partkey AS VARCHAR), l_orderkey, CAST(o_custkey AS VARCHAR) FROM lines
UNION ALL SELECT 'IMPLEMENTS:' || l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || l_partkey, 'Role', CAST(l_suppkey AS VARCHAR), 'IMPLEMENTS', 'Control', CAST(l_partkey AS VARCHAR), l_orderkey, CAST(o_custkey AS VARCHAR) FROM lines
UNION ALL SELECT 'MAPS_TO:' || r || ':' || p, 'Standard', CAST(r AS VARCHAR), 'MAPS_TO', 'Control', CAST(p AS VARCHAR), p, CAST(r AS VARCHAR)
FROM (SELECT DISTINCT n_regionkey AS r, l_partkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nat ON n_nationkey = s_nationkey WHERE l_quantity = 50)
)
"""
