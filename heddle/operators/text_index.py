"""A stored positional index of stems, and conjunctive search that reads only the question's stems.

Postings lie in parts by a hash of the stem, sorted by stem inside each file, so
that a query opens its stems' parts and skips the row groups of other stems.
The question goes through the same words, stop words and stems as the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.functions.stemmer import porter
from heddle.operators import search

#: Parts by stem, and files that a part's postings are dealt to by their text, as a common stem is in most texts.
PARTS, FILES = 64, 8

# The stop words of the English text search configuration.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)

POSTINGS = "stem string, id {id}, positions array<int>"


def stem_part(stem) -> F.Column:
    return F.pmod(F.xxhash64(stem), F.lit(PARTS)).cast("int")


def question_stems(question: str | None) -> list[str]:
    """Distinct stems of a question, in order; none if it has stop words only."""
    import re

    words = re.findall("[a-z]+", (question or "").lower())
    return list(dict.fromkeys(porter(w) for w in words if w not in STOP_WORDS))


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    id_type: str = "bigint"

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"{POSTINGS.format(id=self.id_type)}, part int").parquet(f"{self.path}/postings")

    def of_stems(self, stems: list[str]) -> DataFrame:
        """``(stem, id, positions)`` of some stems, from their parts alone."""
        parts = self.spark.createDataFrame([(s,) for s in stems], "stem string").select(stem_part("stem")).distinct().collect()  # as many as stems
        rows = self.postings().where(F.col("part").isin([r[0] for r in parts]) & F.col("stem").isin(stems))
        return rows.select("stem", "id", "positions")

    def statistics(self) -> DataFrame:
        """``(stem, n_docs, n_occurrences)``."""
        return self.postings().groupBy("stem").agg(F.count("*").alias("n_docs"), F.sum(F.size("positions")).alias("n_occurrences"))


def write_text_index(texts: DataFrame, path: str) -> TextIndex:
    """Index of ``(id, text)``: a row for each text and stem in it, with its positions; positions count stop words too.

    Null texts and ids, and texts without words, have no postings.
    """
    texts = texts.where("id is not null")
    post = search.stemmed(search.postings(texts.select("id", "text"), STOP_WORDS))
    rows = post.groupBy(F.col("lexeme").alias("stem"), "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    rows = rows.select("stem", "id", "positions", stem_part("stem").alias("part"))
    placed = rows.repartition("part", F.pmod(F.xxhash64("id"), F.lit(FILES))).sortWithinPartitions("part", "stem", "id")
    placed.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    return TextIndex(texts.sparkSession, path, dict(texts.dtypes)["id"])


def search_chunks(index: TextIndex, question: str | None, k: int) -> DataFrame:
    """``(id, score, rank)`` of the ``k`` texts that hold all of the question's stems, by cover density; ties by id.

    A question of stop words only, or none, finds nothing.
    """
    stems = question_stems(question)
    if not stems:
        return index.spark.createDataFrame([], f"id {index.id_type}, score double, rank int")
    rows = index.of_stems(stems)
    # whoever lacks a stem is out before positions are unfolded
    able = rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(stems)).select("id")
    post = rows.join(able, "id").select("id", F.explode("positions").alias("pos"), F.col("stem").alias("lexeme"))
    return search.top_k(search.lexical_scores(rows, stems, post), k)
