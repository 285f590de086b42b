"""Documents' two status tracks as keyed streaming state: each piece of news is accepted or rejected.

The ingestion track is a chain; the graph track starts, and starts again, at
``extracting``, which needs a document whose ingestion is ``ready``, and is a
chain from there.  Work under way may fail.  The state of a document is its two
statuses, when each was reached, and which news brought it to each status last,
so it doesn't grow with the number of its news.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# The statuses of both tracks, in order.
INGESTION = ("pending", "parsing", "chunking", "embedding", "ready")
GRAPH = ("not_started", "extracting", "extracted", "resolving", "ready")

NEWS = "event_id string, document_id string, track string, status string, at timestamp"
VERDICTS = "event_id string, document_id string, track string, told string, at timestamp, verdict string, status string, graph_status string"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fresh() -> dict:
    return {"ingestion": [INGESTION[0], None], "graph": [GRAPH[0], None], "by": {}}


def allowed(track: str, was: str, to: str) -> bool:
    """Whether a track may go from one status to another, but for the guard of ``extracting``."""
    chain = GRAPH if track == "graph" else INGESTION
    if to == "failed":
        return was in (chain[1:-1] if track == "graph" else chain[:-1])
    if track == "graph" and to == chain[1]:
        return True
    return was in chain and to in chain and chain.index(to) == chain.index(was) + 1


def judge(state: dict, event_id: str, track: str, to: str, at: int) -> str:
    """The verdict on one piece of news; an accepted one changes ``state``.

    ``repeated``: this very news was accepted before; ``late``: older than what
    its track has; ``not ready``: extraction of a document that isn't ingested;
    ``illegal``: the status doesn't follow, or the track is unknown.
    """
    if track not in ("ingestion", "graph") or at is None:
        return "illegal"
    was, since = state[track]
    if state["by"].get(f"{track}:{to}") == event_id:
        return "repeated"
    if since is not None and at < since:
        return "late"
    if not allowed(track, was, to):
        return "illegal"
    if track == "graph" and to == GRAPH[1] and state["ingestion"][0] != INGESTION[-1]:
        return "not ready"
    state[track] = [to, at]
    state["by"][f"{track}:{to}"] = event_id
    return "accepted"


class Tracks(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracks", "said string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else fresh()
        # what came in one batch is judged in its own order
        news = pd.concat(list(rows)).sort_values(["micros", "number", "event_id"], na_position="last", kind="stable")
        verdicts, ingestion, graph = [], [], []
        for event_id, track, to, micros in zip(news["event_id"], news["track"], news["told"], news["micros"], strict=True):
            verdicts.append(judge(held, event_id, track, to, None if pd.isna(micros) else int(micros)))
            ingestion.append(held["ingestion"][0])
            graph.append(held["graph"][0])
        self.state.update((json.dumps(held),))
        yield news.drop(columns=["number"]).assign(verdict=verdicts, status=ingestion, graph_status=graph)

    def close(self) -> None:
        pass


def verdicts(news: DataFrame) -> DataFrame:
    """A verdict on each piece of ``news``, with both statuses after it.  News without a document, an id or a status has none and is left out.

    News of one batch is taken by time, then by id, as numbers where ids are numbers.
    """
    known = news.where("document_id is not null and event_id is not null and status is not null")
    asked = known.select(
        "event_id", "document_id", "track", F.col("status").alias("told"), F.unix_micros("at").cast("double").alias("micros"), F.expr("try_cast(event_id AS double)").alias("number")
    )
    out = "event_id string, document_id string, track string, told string, micros double, verdict string, status string, graph_status string"
    judged = asked.groupBy("document_id").transformWithStateInPandas(Tracks(), out, "Append", "None")
    return judged.select("event_id", "document_id", "track", "told", F.timestamp_micros(F.col("micros").cast("long")).alias("at"), "verdict", "status", "graph_status")


def start(news: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Judges a stream of news (``NEWS``) into a table of verdicts; with ``once`` it stops when it has caught up.

    The state needs the RocksDB store, which is set for the session.
    """
    news.sparkSession.conf.set(*STORE)
    writer = verdicts(news).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
