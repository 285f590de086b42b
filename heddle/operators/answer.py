"""From a question to an answer with citations: fusion, reranking, graph facts, prompt, answerer.

Whatever depends on the size of the corpus is a join with a bounded side: the
rankings hold a fixed number of rows, and so do the context, the facts that
reach the prompt and the citations.  Candidates are written once, as the
reranker, the prompt, the seeds and the citations all read them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.adapters import DELAYS, Answerer, QuotingAnswerer, persistent
from heddle.functions import text as X
from heddle.operators import graph, search
from heddle.schemas import GRAPH_FACTS, MAX_HOPS, RELATION_KEY, TOP_K
from heddle.session import materialize

# What is said when nothing was found, and the size of an answer.
NOTHING_FOUND, ANSWER_TOKENS = "No relevant information found.", 1024

CHUNK_COLUMNS = ["chunk_id", "filename", "clause_number", "title", "path", "text"]


@dataclass
class Answered:
    """``answer``: one row ``(question, prompt, answer)``; ``citations``: ``(ordinal, chunk_id, filename, clause_number, path, rank)``; ``facts``: ``(place, fact, chunk_id)``."""

    answer: DataFrame
    citations: DataFrame
    facts: DataFrame


def context(rankings: Sequence[DataFrame], chunks: DataFrame, scorer: Callable[[Column], Column], top_n: int = TOP_K) -> DataFrame:
    """The best ``top_n`` chunks, with ``rank``: rankings fused, looked up, reranked.  Ids without a chunk are passed over."""
    fused = search.reciprocal_rank_fusion(rankings).select(F.col("id").alias("chunk_id"), F.col("rank").alias("input_pos"))
    found = materialize(chunks.select(*CHUNK_COLUMNS).join(F.broadcast(fused), "chunk_id"), "candidates")  # at most the rankings' rows
    best = search.rerank(found.withColumnRenamed("chunk_id", "id"), scorer, top_n)
    return materialize(found.join(F.broadcast(best.select("input_pos", "rank")), "input_pos").select("rank", *CHUNK_COLUMNS), "context")


def cited_facts(edges: DataFrame, top: DataFrame, chunks: DataFrame, cap: int = GRAPH_FACTS, hops: int = MAX_HOPS) -> tuple[DataFrame, DataFrame]:
    """``(facts, citations)`` of the context ``top``.

    Facts are the first ``cap`` relations around the entities of the context's
    chunks, by hop; the walk stops at the hop that has enough.  Citations are
    the context's chunks in their order, then the chunks that only facts
    mention, in the order of their first fact.  A fact is labelled with its
    chunk's clause number, or else its chunk's id; one whose chunk is gone
    counts against the cap, but is neither shown nor cited.
    """
    seeds = graph.entities_for_chunks(edges, F.broadcast(top.select("chunk_id")))
    first = graph.capped_facts(graph.expand_hops(edges, seeds, hops, enough=cap), cap)
    place = F.row_number().over(Window.orderBy("hop", *RELATION_KEY)) - 1  # at most ``cap`` rows
    facts = materialize(first.withColumn("place", place), "facts")
    others = facts.join(top, "chunk_id", "left_anti").groupBy("chunk_id").agg(F.min("place").alias("place"))
    more = chunks.join(F.broadcast(others), "chunk_id").select("chunk_id", "filename", "clause_number", "path", F.lit(None).cast("int").alias("rank"), "place")
    own = top.select("chunk_id", "filename", "clause_number", "path", "rank", F.lit(-1).alias("place"))
    ordinal = F.row_number().over(Window.orderBy("place", "rank", "chunk_id"))  # at most ``top_n + cap`` rows
    cited = materialize(own.unionByName(more).withColumn("ordinal", ordinal).drop("place"), "citations")
    label = X.first_filled(F.col("clause_number"), F.col("chunk_id").cast("string"))
    shown = graph.fact_lines(facts.join(F.broadcast(cited.select("chunk_id", "clause_number")), "chunk_id"), label)
    return shown.select("place", "fact", "chunk_id"), cited.select("ordinal", "chunk_id", "filename", "clause_number", "path", "rank")


def answered(prompts: DataFrame, answerer: Answerer, max_tokens: int = ANSWER_TOKENS) -> DataFrame:
    """``(question, prompt, answer)`` of ``(question, prompt)``: a call for each row with a prompt, repeated as the adapter asks for."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [NOTHING_FOUND if p is None else persistent(lambda p=p: answerer.answer(p, max_tokens), DELAYS) for p in frame["prompt"]]
            yield frame.assign(answer=said)

    return prompts.select("question", "prompt").mapInPandas(run, "question string, prompt string, answer string")


def answer_question(
    question: str,
    rankings: Sequence[DataFrame],
    chunks: DataFrame,
    edges: DataFrame,
    scorer: Callable[[Column], Column],
    answerer: Answerer | None = None,
    top_n: int = TOP_K,
    cap: int = GRAPH_FACTS,
) -> Answered:
    """Answers a question from ``rankings`` ``(id, rank)`` of ``chunks`` and the graph of ``edges``.

    ``edges`` should be a written table, as each hop reads it.  Without any
    candidate there are no citations and the answerer isn't asked.
    """
    top = context(rankings, chunks, scorer, top_n)
    facts, cited = cited_facts(edges, top, chunks, cap)
    prompts = search.prompt(question, top, facts.withColumnRenamed("place", "rank"))
    n = top.count()  # at most ``top_n``
    prompts = prompts.select(F.lit(question).alias("question"), F.when(F.lit(n > 0), F.col("prompt")).alias("prompt"))
    return Answered(materialize(answered(prompts, answerer or QuotingAnswerer()), "answer"), cited, facts)
