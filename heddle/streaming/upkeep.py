"""The stored graph kept up to date from a stream of document changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heddle.operators.graph import endpoints
from heddle.operators.resolution import StoredGraph
from heddle.session import free, materialize
from heddle.sources.files import delete, exists

#: A change names its document, orders it, and says whether the document is gone.
CHANGES = "document_id string, seq bigint, deleted boolean, source string, lang string, text string"
LOG, KEYS = "document_id string, seq bigint", "entity_type string, name string"

Load = Callable[[StoredGraph, DataFrame], None]


def plain_load(extract: Callable[[DataFrame], DataFrame]) -> Load:
    """A load without resolution: ``extract`` makes edges of documents, and their ends are the vertices."""

    def load(store: StoredGraph, documents: DataFrame) -> None:
        edges = materialize(extract(documents), "extracted")
        store.upsert(endpoints(edges).withColumn("embedding", F.lit(None).cast("array<double>")))
        store.replace(documents, edges)
        free(edges)

    return load


def newest(changes: DataFrame, log: DataFrame) -> DataFrame:
    """Of each document the last change, if it is later than all that the log has; without a document or an order it is left out.

    Of changes with one ``seq`` a deletion counts, then the greatest text.
    """
    known = changes.where("document_id is not null and seq is not null")
    rest = [c for c in known.columns if c != "document_id"]
    order = F.struct("seq", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("text", F.lit("")).alias("text"))
    last = known.groupBy("document_id").agg(F.max_by(F.struct(*rest), order).alias("c")).select("document_id", "c.*")
    before = log.groupBy("document_id").agg(F.max("seq").alias("logged"))
    return last.join(before, "document_id", "left").where("logged is null or seq > logged").drop("logged")


def apply_changes(store: StoredGraph, changes: DataFrame, batch: str, load: Load) -> int:
    """Brings the graph up to the ``changes`` of one batch; returns how many documents changed.

    Edges of changed documents are replaced, those of deleted ones go, and so do
    vertices that lose their last edge thereby.  The log is written last: a batch
    that was cut off is applied again as a whole, and one that ended changes
    nothing when it is repeated.  What the documents' edges touched before is
    kept under the batch's name until then, as a repetition no longer finds it.
    """
    spark = store.spark
    log_path, touched_path = f"{store.path}/changes", f"{store.path}/touched/{batch}"
    log = spark.read.schema(LOG).parquet(log_path) if exists(spark, log_path) else spark.createDataFrame([], LOG)
    now = materialize(newest(changes, log), "changes")
    n = now.count()
    if n:
        if not exists(spark, f"{touched_path}/_SUCCESS"):
            endpoints(store.edges_of(now)).write.mode("overwrite").parquet(touched_path)
        kept = now.where(~F.coalesce("deleted", F.lit(False)))
        if not kept.isEmpty():
            load(store, kept)
        gone = now.where("deleted")
        if not gone.isEmpty():
            store.replace(gone, store.edges().where("false"))
        store.drop_unused(spark.read.schema(KEYS).parquet(touched_path))
        now.select("document_id", "seq").write.mode("append").parquet(log_path)
        delete(spark, touched_path)
    free(now)
    return n


def start(spark: SparkSession, landing: str, store: StoredGraph, checkpoint: str, load: Load, once: bool = True) -> StreamingQuery:
    """A stream over landed files of changes; with ``once`` it stops when it has caught up."""
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1000).parquet(landing)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply_changes(store, df, f"batch-{i}", load) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
