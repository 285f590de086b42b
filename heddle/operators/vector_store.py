"""A table of vectors by id in which the last write stays, and the stage that embeds chunks into it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.adapters import Embedder, embed_column
from heddle.session import free, materialize
from heddle.sources.files import exists, rewrite_parts

#: Dimension and measure of the collection of chunks; parts by id.
DIMENSION, METRIC, PARTS = 1024, "cosine", 64


@dataclass
class VectorTable:
    spark: SparkSession
    path: str
    dimension: int
    parts: int
    id_type: str

    @staticmethod
    def create(spark: SparkSession, path: str, dimension: int = DIMENSION, parts: int = PARTS, id_type: str = "bigint") -> VectorTable:
        """The collection at ``path``, made if it isn't there; one that is there must have this dimension, parts and ids."""
        want = (dimension, METRIC, parts, id_type)
        if exists(spark, f"{path}/collection"):
            there = tuple(spark.read.parquet(f"{path}/collection").select("dimension", "metric", "parts", "id_type").first())
            if there != want:
                raise ValueError(f"the collection has {there}, not {want}")
        else:
            rows = spark.createDataFrame([want], "dimension int, metric string, parts int, id_type string")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/collection")
        return VectorTable(spark, path, dimension, parts, id_type)

    def rows(self) -> DataFrame:
        """``(id, embedding, seq, part)``."""
        schema = f"id {self.id_type}, embedding array<float>, seq bigint, part int"
        if not exists(self.spark, f"{self.path}/vectors"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def upsert(self, vectors: DataFrame, seq: str) -> None:
        """Writes ``(id, embedding)``; of an id the row of the largest ``seq`` stays, of these the one with the largest vector.

        Rows without an id are no rows.  A vector that is null or of another
        length than the collection's fails the call before anything is written.
        Only parts that get a row are read and written, so the same call twice
        leaves the same table.
        """
        part = F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")
        new = vectors.where("id is not null").select(
            F.col("id").cast(self.id_type).alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col(seq).cast("long").alias("seq")
        )
        new = materialize(new.withColumn("part", part), "vectors")
        wrong = new.where(F.col("embedding").isNull() | (F.size("embedding") != self.dimension)).limit(1).count()
        if wrong:
            free(new)
            raise ValueError(f"a vector hasn't {self.dimension} numbers")
        touched = sorted(r[0] for r in new.select("part").distinct().collect())  # as many as parts at most
        both = self.rows().where(F.col("part").isin(touched)).unionByName(new)
        # null seq is before all others
        last = both.groupBy("id", "part").agg(F.max(F.struct("seq", "embedding")).alias("last")).select("id", "last.embedding", "last.seq", "part")
        last = materialize(last, "merged")
        rewrite_parts(last, f"{self.path}/vectors", "part", touched, "id")
        free(new, last)


def embed_chunks(chunks: DataFrame, table: VectorTable, embedder: Embedder, seq: int) -> None:
    """Embeds ``(chunk_id, text)`` in calls of bounded size and writes the vectors as run number ``seq``."""
    vectors = embed_column(chunks.where("chunk_id is not null"), "chunk_id", "text", embedder)
    table.upsert(vectors.withColumn("seq", F.lit(seq)), "seq")
