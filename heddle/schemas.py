"""Declared schemas and closed domains; nothing is inferred."""

from pyspark.sql import types as T

# The two closed domains, and the fixed sizes of retrieval.
ENTITY_TYPES = ("Standard", "Clause", "Control", "Requirement", "Risk", "Asset", "Process", "Role", "Definition")
RELATION_TYPES = (
    "requires", "references", "implements", "maps_to", "is_prerequisite_for", "applies_to", "defined_in", "part_of", "superseded_by",
)
DENSE_CANDIDATES, LEXICAL_CANDIDATES, TOP_K, GRAPH_FACTS, MAX_HOPS = 20, 20, 5, 30, 2
RRF_K, SIMILARITY_THRESHOLD, MIN_COMMUNITY = 60, 0.90, 2
BATCH_TEXTS, BATCH_TOKENS = 128, 4000

ENTITY = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("entity_type", T.StringType()), T.StructField("description", T.StringType()),
])
RELATION = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("relation_type", T.StringType()), T.StructField("target", T.StringType()),
])
EXTRACTION = T.StructType([T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("relations", T.ArrayType(RELATION))])

EDGE_COLUMNS = ["edge_id", "source_type", "source_name", "relation_type", "target_type", "target_name", "chunk_id", "document_id"]
#: What makes two relations of an expansion the same; the document isn't part of it.
RELATION_KEY = ["source_type", "source_name", "relation_type", "target_type", "target_name", "chunk_id"]

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
