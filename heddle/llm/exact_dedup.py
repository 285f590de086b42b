"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three stages, each comparing whole contents and not just digests:

1. each map task combines its equal texts (the partial side of the first
   aggregation);
2. groups of (digest, text, salt) are merged, the salt splitting a text that a
   large share of all rows may hold;
3. the salts' winners of a text are combined globally.

A document then finds its group by (digest, salt), an even key, as the winners
carry the bounded set of salts in which they occur.  That lookup is exact, as
the winners say which digests stand for one content; documents of any other
digest find their group by content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SALTS = 32


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``.

    Texts are equal when identical; null counts as empty, so all null and empty
    texts are one group.  The largest ``doc_id`` of a group stays (null ids lose
    to others; a group with null ids only has ``keep_id`` null and keeps them).
    ``group_size`` counts rows.  Rows repeated with id and text are each
    returned, and share one verdict.  An empty table gives no rows.  Other
    columns are ignored.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        text.alias("body"),
        F.sha2(text, 256).alias("digest"),
        # neighbours share a salt, so that a map task's own copies combine before the shuffle
        F.pmod(F.xxhash64(F.shiftright(F.coalesce(docs["doc_id"], F.lit(0)), 10)), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = rows.groupBy("digest", "body", "salt").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "body").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
    )
    by_digest = winners.groupBy("digest").agg(
        F.count("*").alias("contents"),
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.array_distinct(F.flatten(F.collect_list("salts"))).alias("salts"),
    )
    # without texts, so narrow; written, as otherwise a second use would shuffle all texts again
    by_digest = materialize(by_digest, "digests")
    single = by_digest.where("contents = 1").select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size")
    found = rows.drop("body").join(single, ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size")
    collisions = by_digest.where("contents > 1").select("digest")
    if not collisions.isEmpty():  # different texts with one SHA-256 digest: their documents go by content
        found = found.union(
            rows.join(collisions, "digest", "left_semi")
            .join(winners.join(collisions, "digest", "left_semi").drop("salts"), ["digest", "body"])
            .select("doc_id", "digest", "keep_id", "group_size")
        )
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    An id may stand for several texts: a row stays by its id and its text's
    digest together.  Rows that repeat both stay together.
    """
    stay = exact_groups(docs, salts).where("kept").select(F.col("doc_id").alias("stays"), F.col("text_sha256").alias("digest")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias("own"))
    return rows.join(stay, (F.col("own") == F.col("digest")) & F.col("id").eqNullSafe(F.col("stays")), "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
