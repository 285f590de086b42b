"""Lexical and dense search, rank fusion, reranking and prompt context."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as X
from heddle.operators import vector_blocks
from heddle.schemas import RRF_K


def postings(texts: DataFrame, stop_words: Sequence[str] = X.STOP_WORDS) -> DataFrame:
    """``(id, pos, lexeme)`` from ``(id, text)``; positions count stop words, which are left out."""
    words = texts.select("id", F.posexplode(X.lexemes(F.col("text"))).alias("pos", "lexeme"))
    return words.where(~F.col("lexeme").isin(*stop_words))


def stemmed(post: DataFrame) -> DataFrame:
    """Postings by stem; the stemmer sees each distinct word once."""
    from heddle.functions.stemmer import stem

    stems = post.select("lexeme").distinct().withColumn("stem", stem("lexeme"))
    return post.join(stems, "lexeme").select("id", "pos", F.col("stem").alias("lexeme"))


def lexeme_statistics(post: DataFrame) -> DataFrame:
    """Documents and occurrences of each lexeme; two aggregations that combine before the shuffle."""
    per_doc = post.groupBy("lexeme", "id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("lexeme").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_occurrences"))


def lexical_scores(texts: DataFrame, terms: Sequence[str], post: DataFrame | None = None) -> DataFrame:
    """``(id, score)`` of the texts that have all terms, by the density of minimal covers.

    A cover is a shortest span with all terms; it adds ``1 / (1 + extra)``,
    ``extra`` being its words beyond the terms.  No length normalisation.  Texts
    without one of the terms are dropped before their words are looked at.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return texts.select("id", F.lit(0.0).alias("score")).where("false")
    if post is None:
        able = texts.where(reduce(lambda a, b: a & b, (F.lower("text").contains(t) for t in terms)))
        post = able.select("id", F.posexplode(X.lexemes(F.col("text"))).alias("pos", "lexeme"))
    hits = post.where(F.col("lexeme").isin(*terms))
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("lexeme") == t, F.col("pos"))).over(so_far) for t in terms]
    covers = hits.select("id", F.col("pos").alias("e"), *(x.alias(f"l{i}") for i, x in enumerate(last)))
    names = [f"l{i}" for i in range(len(terms))]
    covers = covers.where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names)))
    covers = covers.withColumn("b", F.least(*names) if len(names) > 1 else F.col(names[0]))
    shortest = covers.groupBy("id", "b").agg(F.min("e").alias("e"))
    density = F.lit(1.0) / (F.lit(2.0 - len(terms)) + F.col("e") - F.col("b"))
    return shortest.groupBy("id").agg(F.round(F.sum(density), 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best rows by score, ties by id, with a 0-based ``rank``; for each value of ``by`` if given."""
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)
    best = scored.orderBy(F.desc("score"), "id").limit(k)  # at most k rows are ranked in one task
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def dense_scores(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """``(id, score)``: rounded cosine of ``(id, embedding)`` with one query vector."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("id", F.round(X.cosine(F.col("embedding"), literal), 6).alias("score"))


def similar_pairs(vectors: DataFrame, least: float, block: int = 1000) -> DataFrame:
    """``(a, b, score)`` of all pairs ``a < b`` of ids with the same label and a cosine, rounded to six places, of at least ``least``.

    A label's vectors are dealt into blocks of about ``block`` by a hash of the
    id; each two blocks meet in one task, so a common label is many small groups.
    """
    import numpy as np
    import pandas as pd

    rows = vectors.select("id", "embedding", "label").where("id is not null and embedding is not null and label is not null")
    blocks = rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(blocks, "label").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = rows.select("label", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), "id", "embedding")
    # other names, or columns of both sides would be the same to Spark
    other = rows.select(F.col("label").alias("label2"), "own", F.col("id").alias("id2"), F.col("embedding").alias("embedding2"))
    right = other.select("label2", F.explode(F.sequence(F.lit(0), "own")).alias("i2"), F.col("own").alias("j2"), "id2", "embedding2")

    def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        m, n = (np.stack([np.asarray(v, dtype=np.float64) for v in side]) for side in (x["embedding"], y["embedding2"]))
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round(m @ n.T / np.linalg.norm(m, axis=1)[:, None] / np.linalg.norm(n, axis=1), 6)
        p, q = x["id"].to_numpy(), y["id2"].to_numpy()
        # within one block each pair shows up both ways
        at, to = np.nonzero((score >= least) & ((p[:, None] < q) if key[1] == key[2] else (p[:, None] != q)))
        return pd.DataFrame({"a": np.minimum(p[at], q[to]), "b": np.maximum(p[at], q[to]), "score": score[at, to]})

    return left.groupBy("label", "i", "j").cogroup(right.groupBy("label2", "i2", "j2")).applyInPandas(run, "a long, b long, score double")


def dense_pairs(queries: DataFrame, vectors: DataFrame, block: int = 256) -> DataFrame:
    """``(query_id, id, score)`` of every query with every vector, by matrix products.

    Queries are a stated set; each task multiplies its vectors with blocks of
    them, which are broadcast from a collected table of a checked size.
    """
    import numpy as np
    import pyarrow as pa

    rows = queries.select("query_id", "embedding").orderBy("query_id").collect()
    if sum(len(r["embedding"]) for r in rows) > 50_000_000:
        raise ValueError("too many query vectors for one pass; split the query set")
    ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        ids, q = shared.value
        if not len(ids):
            return
        qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            own = batch.column(0).to_numpy()
            for at in range(0, len(ids), block):
                s = np.round(v @ qn[at : at + block].T, 6)
                n = s.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(ids[at : at + block], len(own))), pa.array(np.repeat(own, n)), pa.array(s.ravel())],
                    names=["query_id", "id", "score"],
                )

    return vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(run, "query_id long, id long, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` best of ``vectors(id, embedding)`` for each of ``queries(query_id, embedding)``, compared with all of them.

    Each task keeps its ``k`` best of a query, so the table of all pairs is
    never written, and nothing of either side passes the driver.
    """
    kept = vector_blocks.compared(queries, vectors, lambda q, v, order: vector_blocks.best(q, v, order, k))
    return top_k(kept, k, by=["query_id"])


def reciprocal_rank_fusion(rankings: Sequence[DataFrame], k: int = RRF_K, by: Sequence[str] = ()) -> DataFrame:
    """``(id, score, rank)`` from rankings ``(id, rank)``; ties keep the order of first appearance."""
    tagged = [r.select(*by, "id", "rank", F.lit(i).alias("source")) for i, r in enumerate(rankings)]
    both = reduce(DataFrame.unionByName, tagged)
    term = F.lit(1.0) / (F.lit(float(k + 1)) + F.col("rank"))
    fused = both.groupBy(*by, "id").agg(F.round(F.sum(term), 6).alias("score"), F.min(F.struct("source", "rank")).alias("seen"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    # as many rows as the rankings hold, so a bounded number
    return fused.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "seen")) - 1).drop("seen")


def overlap_score(terms: Sequence[str]) -> Callable[[Column], Column]:
    """Default scorer of the rerank seam: the share of a text's words that are query terms."""

    def score(text: Column) -> Column:
        words = X.lexemes(text)
        hits = F.size(F.filter(words, lambda w: w.isin(*terms)))
        return F.round(hits / F.greatest(F.size(words), F.lit(1)), 6)

    return score


def rerank(candidates: DataFrame, scorer: Callable[[Column], Column], top_n: int) -> DataFrame:
    """``(input_pos, id, relevance, rank)``: the best ``top_n`` of ``(input_pos, id, text)``, ties in input order."""
    scored = candidates.select("input_pos", "id", scorer(F.col("text")).alias("relevance"))
    best = scored.orderBy(F.desc("relevance"), "input_pos").limit(top_n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("relevance"), "input_pos")) - 1)


def excerpts(context: DataFrame) -> DataFrame:
    """Numbered excerpts ``[i] (label) text`` of ``(rank, clause_number, title, text)``."""
    number = (F.col("rank") + 1).cast("string")
    label = X.first_filled(F.col("clause_number"), F.col("title"), F.concat(F.lit("chunk "), number))
    return context.withColumn("excerpt", F.concat(F.lit("["), number, F.lit("] ("), label, F.lit(") "), F.col("text")))


def prompt(question: str, context: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row with the prompt: excerpts in rank order, facts if there are any, the question."""
    def joined(df: DataFrame, column: str, sep: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("rank", column)))
        return df.agg(F.array_join(F.transform(parts, lambda p: p[column]), sep).alias(column), F.count("*").alias("n_" + column))

    out = joined(excerpts(context), "excerpt", "\n\n")
    text = F.concat(F.lit("Excerpts:\n\n"), F.col("excerpt"))
    if facts is not None:
        out = out.crossJoin(joined(facts, "fact", "\n"))  # one row by one row
        text = F.concat(text, F.when(F.col("n_fact") > 0, F.concat(F.lit("\n\nGraph-derived facts:\n\n"), F.col("fact"))).otherwise(""))
    return out.select(F.concat(text, F.lit(f"\n\nQuestion: {question}")).alias("prompt"))
