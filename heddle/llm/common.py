"""What several operators of this subpackage share."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.components import connected, extended
from heddle.session import free, materialize

#: Code points with the Unicode property White_Space, as a regex class body.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Words of the contracts: runs without the six ASCII white-space characters.
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader (any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others of the input can't clash with ours."""
    return df.select(*(df[n] for n in names))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, counting no further."""
    return df.limit(rows + 1).count() <= rows


def bucket_components(members: DataFrame, near, verify, hub_rounds: int = 2) -> DataFrame:
    """Components of the nodes that share a bucket, are ``near`` and pass ``verify``.

    ``members`` is a written table of ``key``, ``node``, ``rank`` and what
    ``near`` needs.  ``near(x, y)`` is a Column over two aliases of it;
    ``verify(pairs)`` returns those of the pairs ``(a, b)`` that are linked, as
    a written table.

    Buckets aren't expanded into all their pairs.  In each hub round, a bucket's
    members are compared with one of them: the one of the largest rank, then the
    one of the largest rank outside the bucket's main component.  Then what isn't
    in that component yet is compared with the members of other components, so
    that no link is lost.  Returns ``(node, component)`` for nodes with a link.
    """
    labels = None
    rest = [c for c in members.columns if c not in ("key", "node", "rank")]
    hub = F.max(F.struct("rank", "node", "label", *rest)).alias("hub")
    for k in range(hub_rounds + 1):
        if labels is None:
            now = members.withColumn("label", F.col("node"))
            hubs = now.groupBy("key").agg(hub, F.count("*").alias("n")).where("n > 1")
        else:
            now = members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
            mains = now.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
            mains = mains.agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("key", "main.label")
            mains = mains.withColumnRenamed("label", "main")
            apart = now.join(mains, "key").where("label <> main")
            hubs = apart.groupBy("key").agg(hub)
        if k < hub_rounds:
            pairs = now.alias("x").join(hubs.select("key", "hub.*").alias("y"), "key").where("x.label <> y.label")
        else:
            # of two that are both apart, one order is enough
            pairs = apart.alias("x").join(now.alias("y"), "key").where("x.label < y.label or x.label > y.label and y.label = x.main")
        pairs = pairs.where(near("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        pairs = materialize(pairs.distinct(), "pairs")
        if labels is not None and pairs.isEmpty():
            continue
        new = verify(pairs)
        labels = materialize(connected(new), "labels") if labels is None else extended(labels, new)
        free(pairs)
    return labels


def crc_mod(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string")) % mod


@functools.cache
def chunk_pattern():
    """Text as pieces that byte-level pre-tokenizers treat each on its own.

    A piece is a run of white space with the run of other characters after it;
    no match of the pre-tokenizers' patterns crosses the end of such a piece.
    """
    import re

    return re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Cutter:
    """Cuts long words where no token of a vocabulary can cross, so that the parts are merged on their own with the same result."""

    def __init__(self, tokens):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for t in tokens:
            if len(t) > 1:
                self.found.add_word(t.decode("latin-1"), len(t))
        self.found.make_automaton()

    def cut(self, word: bytes) -> list[bytes]:
        crossed = np.zeros(len(word) + 1, dtype=np.int32)
        for end, size in self.found.iter(word.decode("latin-1")):
            crossed[end - size + 2] += 1  # places inside the token, counted by the letter that follows
            crossed[end + 1] -= 1
        places = np.flatnonzero(np.cumsum(crossed)[1 : len(word)] == 0) + 1
        bounds = [0, *places.tolist(), len(word)]
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


class Memory(dict):
    """Remembers a bounded number of things; when full, what was used since the last time stays."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def unknown(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that aren't remembered."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
        new = keys.difference(self)
        back = [k for k in new if k in self.older]  # an intersection would walk all older ones
        self.update((k, self.older[k]) for k in back)
        return list(new.difference(back))

    def forget_long(self, keys: list[str]) -> None:
        """Long keys are rarely met again and would take room."""
        for k in keys:
            if len(k) > 64:
                self.pop(k, None)
