"""Uploads, deduplication by content hash, and the job log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as X


def register(uploads: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """New rows of the document register from ``(doc_id, filename, content)``.

    Of equal contents the first upload counts; contents that ``registered``
    already has (by ``sha256_hash``) give no row.  Only hashes and ids move.
    """
    hashed = uploads.select("doc_id", "filename", X.sha256_hex(F.col("content")).alias("sha256_hash"))
    first = hashed.groupBy("sha256_hash").agg(F.min(F.struct("doc_id", "filename")).alias("row"))
    new = first.select("row.doc_id", "row.filename", "sha256_hash")
    if registered is not None:
        new = new.join(registered.select("sha256_hash"), "sha256_hash", "left_anti")
    return new.select(
        "doc_id", "filename", "sha256_hash", X.object_key(F.col("sha256_hash"), F.col("filename")).alias("minio_object_key"),
        F.lit("pending").alias("status"), F.lit("not_started").alias("graph_status"),
    )


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Contents that several documents have."""
    return (
        docs.groupBy(X.sha256_hex(F.col("text")).alias("sha256_hash"))
        .agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
        .where("n_documents > 1")
    )


def latest_status(log: DataFrame) -> DataFrame:
    """The last status of each document, and how many log rows it has; combines before the shuffle."""
    last = F.max(F.struct("at", "job_id", "status"))
    return log.groupBy("document_id").agg(last.alias("l"), F.count("*").alias("n_jobs")).select("document_id", F.col("l.status").alias("status"), F.col("l.at").alias("at"), "n_jobs")


def durations(log: DataFrame) -> DataFrame:
    """Whole seconds from each log row to the document's next one."""
    w = Window.partitionBy("document_id").orderBy("at", "job_id")
    seconds = F.unix_seconds(F.lead("at").over(w)) - F.unix_seconds("at")
    return log.select("job_id", "document_id", "status", seconds.alias("seconds"))


def transitions_allowed(status: Column, to: Column) -> Column:
    """Whether an ingestion status may follow another."""
    chain = ["pending", "parsing", "chunking", "embedding", "ready"]
    ok = F.lit(False)
    for a, b in zip(chain, chain[1:], strict=False):
        ok = ok | ((status == a) & (to == b))
    return ok | ((to == "failed") & status.isin(*chain[:-1]))


def health(probes: DataFrame) -> DataFrame:
    """``ok`` if all probes are, else ``degraded``."""
    return probes.agg(F.when(F.every(F.col("ok")), "ok").otherwise("degraded").alias("status"), F.count("*").alias("n_probes"))
