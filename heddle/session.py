"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "heddle", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only in plain local mode, where driver and executor are one process, an
    unset value falls back to a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix=f"heddle-{os.getpid()}-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages
    before this table.  The files go when the driver's JVM ends, or by :func:`free`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heddle/{label}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(path)
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files; the session's own setting is as before afterwards."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def free(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read any more."""
    for df in tables:
        found = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for path in found:
            if "/heddle/" not in path:
                raise ValueError(f"not a written intermediate table: {path}")
            files, place = _files(df.sparkSession, path)
            files.delete(place, True)
