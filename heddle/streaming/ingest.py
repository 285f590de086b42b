"""Incremental ingestion: a landing folder to document and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heddle.functions import text as X
from heddle.operators import sections
from heddle.sources import files


def chunk_files(raw: DataFrame) -> DataFrame:
    """Chunks of text files with headings."""
    tree = sections.heading_tree(files.text_sections(raw))
    slugs = raw.select(F.col("sha256_hash").alias("doc_id"), X.document_slug(F.col("filename")).alias("slug")).dropDuplicates(["doc_id"])
    return sections.build_chunks(tree.join(slugs, "doc_id"))


def ingest_batch(batch: DataFrame, target: str) -> int:
    """Adds the batch's new contents to ``target/documents`` and their chunks to ``target/chunks``; returns how many.

    The document row is written last, so a batch that failed midway is taken up
    again as a whole; chunk rows are added by content, so none comes twice.
    """
    raw = batch.dropDuplicates(["sha256_hash"])
    chunks = chunk_files(raw).withColumn("chunk_key", F.concat_ws(":", "doc_id", F.col("pos").cast("string")))
    files.append_new(chunks, f"{target}/chunks", "chunk_key")
    docs = raw.select("sha256_hash", "filename", X.object_key(F.col("sha256_hash"), F.col("filename")).alias("minio_object_key"), F.lit("ready").alias("status"))
    return files.append_new(docs, f"{target}/documents", "sha256_hash")


def start(spark: SparkSession, landing: str, target: str, checkpoint: str, glob: str = "*.txt", once: bool = True) -> StreamingQuery:
    """A stream over the landing folder; with ``once`` it stops when it has caught up."""
    stream = files.raw_object_stream(spark, landing, glob)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest_batch(df, target) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
