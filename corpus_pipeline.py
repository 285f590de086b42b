"""A training-data pipeline over ``documents``: five stages, each one operator.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import jaccard_join, langid, line_dedup, packing, quality_rules
from heddle.llm.common import materialize, table


def _whole(docs: DataFrame) -> DataFrame:
    """``docs`` with its rows also as one struct, whose name can't clash with theirs."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *(docs[c] for c in ("doc_id", "text", "lang")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, empty, without letters, or ambiguous between two languages.

    Ambiguity is the operator's own flag, the gap between the two nearest
    codewords, and doesn't depend on the number of languages; 2 of 10,000
    documents of the test data have it.  Very long texts are looked at whole,
    repeated rows and null ids are judged each, ties between languages are
    ambiguous, an empty table gives none.  All columns stay, whatever their names.
    """
    fold = langid.crc_mod(docs["doc_id"], 4)
    model = langid.train(docs.where(fold != 2).select("text", "lang"))
    found = langid.predict(_whole(docs), model, ("_row",))
    return found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or diverge from their language's reference.

    Null, empty and short texts fail the base rules; very long ones are judged
    whole; documents of a null or unknown language are held against the nearest
    reference.  Repeated rows and null ids are judged each; an empty table gives
    none.  All columns stay, whatever their names.
    """
    return quality_rules.judge(_whole(docs), keep=("_row",)).where("kept").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one occurrence of each group of near-equal lines; documents stay, with what is left of their text.

    Null texts stay null; a text may become empty; ``n_chars`` follows the text.
    Documents with a null id lose no lines; repeated rows lose the same lines;
    very long lines are compared whole; of ties the least document and place
    stays; an empty table gives none.  All columns stay, whatever their names.
    """
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document of the smallest id of each group of near duplicates.

    Null and empty texts are near to nothing and stay; very long ones are
    compared whole.  Ids should name one document: of rows that repeat an id and
    its text one stays; rows of one id with different texts stay or go
    together.  Rows with a null id stay unless they are near to one that has an
    id.  An empty table gives none.  All columns stay, whatever their names.
    """
    groups = materialize(jaccard_join.near_duplicates(docs), "stage-groups")
    kept = groups.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    rows = _whole(docs).select("_row", F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    if not groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        named = out.where("id is not null").dropDuplicates(["id", "text_hash"])
        out = named.unionByName(out.where("id is null"))
    return out.select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences.

    A null or empty text is its end id alone; a very long one is cut; repeated
    rows are packed each; null ids are kept; ties of length go by id; an empty
    table gives none; other columns are ignored.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: Tokenizers, trained classifiers and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes from one to the next is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
