"""Stages with a job log: running, then success or failed."""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

LOG = "document_id string, task_name string, status string, error_message string, at timestamp"


@contextlib.contextmanager
def stage(spark: SparkSession, path: str, document_id: str, task: str, now: Callable[[], datetime.datetime] | None = None) -> Iterator[None]:
    """Appends ``running`` before and ``success`` or ``failed`` after the work to the log at ``path``.

    An error is logged with its message and raised again; a later success has
    none, so an old message doesn't stick.
    """
    clock = now or (lambda: datetime.datetime.now(datetime.timezone.utc))

    def say(status: str, problem: str | None = None) -> None:
        spark.createDataFrame([(document_id, task, status, problem, clock())], LOG).write.mode("append").parquet(path)

    say("running")
    try:
        yield
    except Exception as problem:
        say("failed", str(problem))
        raise
    say("success")
