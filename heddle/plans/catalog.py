"""The library's queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as X
from heddle.operators import answer, community, community_job, evaluation, extraction, graph, ingest, resolution, search, sections, text_index, vector_index, vector_store
from heddle.operators.components import connected
from heddle.schemas import BATCH_TEXTS, BATCH_TOKENS, DENSE_CANDIDATES, ENTITY_TYPES, GRAPH_FACTS, LEXICAL_CANDIDATES, RELATION_KEY, RELATION_TYPES, TOP_K
from heddle.session import materialize, shared_dir
from heddle.sources.tables import STAR_SQL, chunk_rows, star_edges, table
from heddle.streaming import status, upkeep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The question of the fixed retrieval queries: its words, and the vector that stands for it.
TERMS, QUESTION, QUERY_VECTOR = ("the", "thing"), "what is the thing", 0
STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- ingestion

CHUNK_SQL = """
chunk AS (
SELECT doc_id || ':' || (i - 1) AS chunk_id, doc_id, CAST(i - 1 AS INT) AS order_in_parent, source || '.d' || doc_id || '.p' || (i - 1) AS path, source, lang, line AS text
FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
WHERE length(line) > 0)
"""


def uploads(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", name.alias("filename"), F.col("text").alias("content"))


@query("upload_dedup", """
SELECT doc_id, filename, sha256_hash, sha256_hash || '/' || filename AS minio_object_key, 'pending' AS status, 'not_started' AS graph_status
FROM (SELECT doc_id, source || '_' || doc_id || '.txt' AS filename, sha256(text) AS sha256_hash, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""")  # fmt: skip
def upload_dedup(spark, d):
    return ingest.register(uploads(spark, d))


@query("upload_incremental", """
WITH h AS (SELECT doc_id, source || '_' || doc_id || '.txt' AS filename, sha256(text) AS sha256_hash FROM documents),
old AS (SELECT DISTINCT sha256(text) AS sha256_hash FROM documents WHERE lang = 'en')
SELECT sha256_hash, min(doc_id) AS doc_id FROM h WHERE sha256_hash NOT IN (SELECT sha256_hash FROM old) GROUP BY sha256_hash
""")
def upload_incremental(spark, d):
    old = table(spark, d, "documents").where("lang = 'en'").select(F.sha2("text", 256).alias("sha256_hash"))
    return ingest.register(uploads(spark, d), old).select("sha256_hash", "doc_id")


@query("duplicate_groups", """
SELECT sha256(text) AS sha256_hash, count(*) AS n_documents, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def duplicate_groups(spark, d):
    return ingest.duplicate_groups(table(spark, d, "documents"))


LOG_SQL = "log AS (SELECT event_id AS job_id, user_id AS document_id, event_type AS status, ts AS moment FROM events)"


def job_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"))


@query("job_latest_status", f"""
WITH {LOG_SQL} SELECT document_id, status, CAST(floor(epoch(moment)) AS BIGINT) AS at_seconds, n_jobs FROM (
SELECT *, count(*) OVER (PARTITION BY document_id) AS n_jobs, row_number() OVER (PARTITION BY document_id ORDER BY moment DESC, job_id DESC) AS n FROM log) WHERE n = 1
""")
def job_latest_status(spark, d):
    return ingest.latest_status(job_log(spark, d)).select("document_id", "status", F.unix_seconds("at").alias("at_seconds"), "n_jobs")


STATUS_SQL = """
told AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'graph' ELSE 'ingestion' END AS track,
  CASE WHEN event_id % 3 = 0 THEN CASE event_type WHEN 'signup' THEN 'extracting' WHEN 'view' THEN 'extracted' WHEN 'click' THEN 'resolving' WHEN 'purchase' THEN 'ready' ELSE 'failed' END
  ELSE CASE event_type WHEN 'signup' THEN 'parsing' WHEN 'view' THEN 'chunking' WHEN 'click' THEN 'embedding' WHEN 'purchase' THEN 'ready' ELSE CASE WHEN event_id % 20 = 1 THEN 'failed' ELSE 'parsing' END END END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
chain(track, was, now) AS (VALUES ('ingestion', 'pending', 'parsing'), ('ingestion', 'parsing', 'chunking'), ('ingestion', 'chunking', 'embedding'), ('ingestion', 'embedding', 'ready'),
  ('graph', 'extracting', 'extracted'), ('graph', 'extracted', 'resolving'), ('graph', 'resolving', 'ready')),
step AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS event_id, 'pending' AS i, 'not_started' AS g, '' AS verdict FROM (SELECT DISTINCT user_id FROM told)
  UNION ALL SELECT user_id, n, event_id, CASE WHEN verdict = 'accepted' AND track = 'ingestion' THEN status ELSE i END, CASE WHEN verdict = 'accepted' AND track = 'graph' THEN status ELSE g END, verdict
  FROM (SELECT t.*, s.i, s.g, CASE WHEN t.track = 'graph' AND t.status = 'extracting' THEN CASE WHEN s.i = 'ready' THEN 'accepted' ELSE 'not ready' END
    WHEN t.status = 'failed' AND t.track = 'ingestion' AND s.i NOT IN ('ready', 'failed') THEN 'accepted' WHEN t.status = 'failed' AND t.track = 'graph' AND s.g IN ('extracting', 'extracted', 'resolving') THEN 'accepted'
    WHEN EXISTS (SELECT 1 FROM chain c WHERE c.track = t.track AND c.now = t.status AND c.was = CASE WHEN t.track = 'graph' THEN s.g ELSE s.i END) THEN 'accepted' ELSE 'illegal' END AS verdict
    FROM step s JOIN told t ON t.user_id = s.user_id AND t.n = s.n + 1))
"""


@query("document_states", f"WITH RECURSIVE {STATUS_SQL} SELECT event_id, CAST(user_id AS VARCHAR) AS document_id, verdict, i AS status, g AS graph_status FROM step WHERE n > 0")
def document_states(spark, d):
    """The event table as news of documents on both tracks, through the state machine as a stream."""
    c = F.col
    of = lambda *names: F.element_at(F.create_map(*(F.lit(x) for kind, to in zip(("signup", "view", "click", "purchase"), names, strict=True) for x in (kind, to))), c("event_type"))
    late = F.when(c("event_id") % 20 == 1, "failed").otherwise("parsing")
    graphs = c("event_id") % 3 == 0
    told = F.when(graphs, F.coalesce(of("extracting", "extracted", "resolving", "ready"), F.lit("failed"))).otherwise(F.coalesce(of("parsing", "chunking", "embedding", "ready"), late))
    base = f"{shared_dir(spark)}/heddle/states-{uuid.uuid4().hex}"
    news = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select(
        c("event_id").cast("string").alias("event_id"), c("user_id").cast("string").alias("document_id"), F.when(graphs, "graph").otherwise("ingestion").alias("track"), told.alias("status"), c("ts").cast("timestamp").alias("at")
    )
    status.start(news, f"{base}/verdicts", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(status.VERDICTS).parquet(f"{base}/verdicts").select(c("event_id").cast("long").alias("event_id"), "document_id", "verdict", "status", "graph_status")


@query("job_durations", f"""
WITH {LOG_SQL} SELECT job_id, document_id, status, CAST(floor(epoch(lead(moment) OVER w)) AS BIGINT) - CAST(floor(epoch(moment)) AS BIGINT) AS seconds
FROM log WINDOW w AS (PARTITION BY document_id ORDER BY moment, job_id)
""")
def job_durations(spark, d):
    return ingest.durations(job_log(spark, d))


@query("health_summary", """
SELECT CASE WHEN bool_and(n > 0) THEN 'ok' ELSE 'degraded' END AS status, count(*) AS n_probes FROM (
SELECT count(*) AS n FROM documents UNION ALL SELECT count(*) FROM embeddings UNION ALL SELECT count(*) FROM pages UNION ALL SELECT count(*) FROM events)
""")
def health_summary(spark, d):
    probes = [table(spark, d, t).agg((F.count("*") > 0).alias("ok")) for t in ("documents", "embeddings", "pages", "events")]
    out = probes[0]
    for p in probes[1:]:
        out = out.unionByName(p)
    return ingest.health(out)


@query("token_spend_by_type", """
SELECT event_type AS path, count(*) AS n, round(sum(value), 2) AS spend FROM events GROUP BY 1
""")
def token_spend_by_type(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("path"), F.lit(0.0).alias("seconds"), F.col("value").alias("spend"))
    return evaluation.by_path(log).select("path", "n", "spend")


# ------------------------------------------------------- sections and chunks


@query("chunk_paragraphs", f"WITH {CHUNK_SQL} SELECT chunk_id, doc_id, order_in_parent, path, CAST(length(text) AS INT) AS n_chars, sha256(text) AS content_hash FROM chunk")
def chunk_paragraphs(spark, d):
    return chunk_rows(table(spark, d, "documents")).select(
        "chunk_id", "doc_id", "order_in_parent", "path", F.length("text").alias("n_chars"), X.sha256_hex(F.col("text")).alias("content_hash")
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def block_sql() -> str:
    """``block(doc_id, i, level, text)`` of all pages."""
    html = "html"
    for pattern, to in sections.REWRITES:
        html = f"regexp_replace({html}, {_sql_text(pattern)}, {_sql_text(to)}, 'g')"
    text = f"CASE WHEN starts_with(b, '{sections.HEADING}') THEN substr(b, 3) ELSE b END"
    for name, letter in sections.CHARACTERS:
        text = f"replace({text}, {_sql_text(name)}, {_sql_text(letter)})"
    return f"""
cut AS (SELECT page_id AS doc_id, string_split({html}, '{sections.BOUND}') AS bs FROM pages),
each AS (SELECT doc_id, unnest(bs) AS b, unnest(range(len(bs))) AS i FROM cut),
block AS (SELECT * FROM (SELECT doc_id, i, CASE WHEN starts_with(b, '{sections.HEADING}') THEN CAST(substr(b, 2, 1) AS INT) ELSE 0 END AS level, trim({text}) AS text FROM each) WHERE length(text) > 0),
sect AS (SELECT doc_id, CAST(s - 1 AS INT) AS pos, max(level) AS level, max(text) FILTER (WHERE level > 0) AS title, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (WHERE level = 0), '') AS text
  FROM (SELECT *, count(*) FILTER (WHERE level > 0) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM block) WHERE s > 0 GROUP BY doc_id, s)
"""


def parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    return sections.block_sections(sections.page_blocks(table(spark, d, "pages")))


@query("page_blocks", f"WITH {block_sql()} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, level, text FROM block")
def page_blocks(spark, d):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long")
    return sections.page_blocks(table(spark, d, "pages")).select("doc_id", place.alias("place"), "level", "text")


@query("parsed_sections", f"WITH {block_sql()} SELECT * FROM sect")
def parsed_sections(spark, d):
    return parsed_pages(spark, d)


#: Headings of all pages, numbered in each of the styles of clauses.
STYLES = ("Article {0}", "Annex B.{0}.{1}", "A.{0}.{1}", "{0}.{1}", "")
STYLE_SQL = "[" + ", ".join("'" + s.replace("{0}", "' || (doc_id % 90 + 1) || '").replace("{1}", "' || (pos + 1) || '") + "'" for s in STYLES) + "]"


@query("clause_numbers", f"""
WITH {block_sql()}, h AS (SELECT doc_id, pos, ({STYLE_SQL})[1 + doc_id % {len(STYLES)}] || ' ' || title AS title FROM sect)
SELECT doc_id, pos, coalesce(nullif(regexp_extract(trim(title), '(?i)^(Article\\s+\\d+[a-z]?)\\b', 1), ''), nullif(regexp_extract(trim(title), '(?i)^(Annex\\s+[A-Z](?:\\.\\d+)*)\\b', 1), ''),
nullif(regexp_extract(trim(title), '^([A-Z]\\.\\d+(?:\\.\\d+)*)\\b', 1), ''), nullif(regexp_extract(trim(title), '^(\\d+(?:\\.\\d+)+)\\b', 1), '')) AS clause_number,
coalesce(nullif(lower(trim(regexp_replace(trim(title), '[^a-zA-Z0-9_]+', '_', 'g'), '_')), ''), 'section') AS label FROM h
""")
def clause_numbers(spark, d):
    number = lambda s: F.format_string(s.replace("{0}", "%1$d").replace("{1}", "%2$d"), F.col("doc_id") % 90 + 1, F.col("pos") + 1)
    style = F.get(F.array(*map(number, STYLES)), (F.col("doc_id") % len(STYLES)).cast("int"))
    rows = parsed_pages(spark, d).withColumn("title", F.concat(style, F.lit(" "), F.col("title")))
    return rows.select("doc_id", "pos", X.clause_number(F.col("title")).alias("clause_number"), X.path_label(F.col("title")).alias("label"))


#: Lines of all documents as an outline: the level goes by the length, and every fifth length has no text of its own.
OUTLINE_SQL = f"""{CHUNK_SQL},
t AS MATERIALIZED (SELECT doc_id, order_in_parent AS pos, CAST(1 + length(text) % 4 AS INT) AS level, text AS title, length(text) % 5 > 0 AS has_text, source || '_' || doc_id AS slug FROM chunk),
p AS MATERIALIZED (SELECT a.doc_id, a.pos, any_value(a.level) AS level, any_value(a.title) AS title, any_value(a.has_text) AS has_text, any_value(a.slug) AS slug, max(b.pos) AS parent
  FROM t a LEFT JOIN t b ON b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY a.doc_id, a.pos)
"""


def outline(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_rows(table(spark, d, "documents"))
    n = F.length("text")
    slug = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    return c.select("doc_id", F.col("order_in_parent").alias("pos"), (1 + n % 4).cast("int").alias("level"), F.col("text").alias("title"), F.when(n % 5 > 0, F.col("text")).otherwise("").alias("text"), slug.alias("slug"))


@query("heading_tree", f"WITH {OUTLINE_SQL} SELECT doc_id, pos, level, parent AS parent_pos FROM p")
def heading_tree(spark, d):
    return sections.heading_tree(outline(spark, d)).select("doc_id", "pos", "level", "parent_pos")


CLAUSE_SQL = """coalesce(nullif(regexp_extract(trim({0}), '(?i)^(Article\\s+\\d+[a-z]?)\\b', 1), ''), nullif(regexp_extract(trim({0}), '(?i)^(Annex\\s+[A-Z](?:\\.\\d+)*)\\b', 1), ''),
  nullif(regexp_extract(trim({0}), '^([A-Z]\\.\\d+(?:\\.\\d+)*)\\b', 1), ''), nullif(regexp_extract(trim({0}), '^(\\d+(?:\\.\\d+)+)\\b', 1), ''))"""
SECTION_SQL = f"""{OUTLINE_SQL},
l AS MATERIALIZED (SELECT *, {CLAUSE_SQL.format('title')} AS clause,
  row_number() OVER (PARTITION BY doc_id, parent ORDER BY pos) - 1 AS place FROM p),
n AS MATERIALIZED (SELECT *, coalesce(nullif(lower(trim(regexp_replace(trim(coalesce(clause, title)), '[^a-zA-Z0-9_]+', '_', 'g'), '_')), ''), 'section') AS label FROM l),
w AS (SELECT doc_id, pos, label AS path, parent AS above, CAST(NULL AS INT) AS found FROM n WHERE has_text
  UNION ALL SELECT w.doc_id, w.pos, n.label || '.' || w.path, n.parent, CASE WHEN w.found IS NULL AND n.has_text THEN n.pos ELSE w.found END FROM w JOIN n ON n.doc_id = w.doc_id AND n.pos = w.above),
sc AS MATERIALIZED (SELECT n.doc_id, n.pos, clause AS clause_number, lower(slug) || '.' || w.path AS path, w.found AS chunk_parent_pos, CAST(n.place AS INT) AS order_in_parent
  FROM n JOIN w ON w.doc_id = n.doc_id AND w.pos = n.pos AND w.above IS NULL)
"""


@query("section_chunks", f"WITH RECURSIVE {SECTION_SQL} SELECT * FROM sc")
def section_chunks(spark, d):
    return sections.build_chunks(sections.heading_tree(outline(spark, d))).select("doc_id", "pos", "clause_number", "path", "chunk_parent_pos", "order_in_parent")


@query("chunk_parents", f"""
WITH RECURSIVE {SECTION_SQL}, c AS MATERIALIZED (SELECT a.doc_id, a.pos, a.path, b.path AS parent_path FROM sc a LEFT JOIN sc b ON b.doc_id = a.doc_id AND b.pos = a.chunk_parent_pos)
SELECT a.doc_id, a.pos, md5(a.path) AS path, max(b.pos) AS parent_id FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id AND b.path = a.parent_path AND b.pos < a.pos GROUP BY ALL
""")
def chunk_parents(spark, d):
    headings = outline(spark, d).withColumn("text", F.substring("text", 1, 1))  # whether there is one
    found = sections.paths(sections.heading_tree(headings))
    # paths are compared by their digests, which is what is returned
    c = materialize(found.select("doc_id", "pos", F.md5("path").alias("path"), "chunk_parent_pos"), "section-chunks")
    above = c.select("doc_id", F.col("pos").alias("chunk_parent_pos"), F.col("path").alias("parent_path"))
    rows = c.join(above, ["doc_id", "chunk_parent_pos"], "left").select("doc_id", "pos", "path", "parent_path")
    return sections.latest_preceding_parent(rows).select("doc_id", "pos", "path", "parent_id")


@query("subtree_query", f"WITH {CHUNK_SQL} SELECT chunk_id, path FROM chunk WHERE path = 'src1' OR starts_with(path, 'src1.')")
def subtree_query(spark, d):
    return chunk_rows(table(spark, d, "documents")).where(X.in_subtree(F.col("path"), "src1")).select("chunk_id", "path")


@query("chunks_by_path", f"WITH {CHUNK_SQL} SELECT chunk_id, path, CAST(row_number() OVER (ORDER BY path) AS INT) AS place FROM chunk WHERE doc_id = 0")
def chunks_by_path(spark, d):
    own = chunk_rows(table(spark, d, "documents").where("doc_id = 0"))
    return own.select("chunk_id", "path", F.row_number().over(Window.orderBy("path")).alias("place"))


@query("page_sections", """
SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, array_to_string(regexp_extract_all(html, '<p>([^<]+)</p>', 1), chr(10)) AS text,
CAST(len(regexp_extract_all(html, '<p>([^<]+)</p>', 1)) AS INT) AS n_paragraphs FROM pages
""")
def page_sections(spark, d):
    return sections.page_sections(table(spark, d, "pages"))


@query("token_batches", f"""
WITH RECURSIVE {CHUNK_SQL},
t AS (SELECT doc_id, order_in_parent AS pos, len(regexp_extract_all(text, '[^ ]+')) AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY order_in_parent) AS i FROM chunk),
b AS (SELECT doc_id, pos, i, 0 AS batch, 1 AS n, tokens AS total FROM t WHERE i = 1
  UNION ALL SELECT t.doc_id, t.pos, t.i, CASE WHEN b.n >= {BATCH_TEXTS} OR b.total + t.tokens > {BATCH_TOKENS} THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.n >= {BATCH_TEXTS} OR b.total + t.tokens > {BATCH_TOKENS} THEN 1 ELSE b.n + 1 END,
    CASE WHEN b.n >= {BATCH_TEXTS} OR b.total + t.tokens > {BATCH_TOKENS} THEN t.tokens ELSE b.total + t.tokens END
  FROM b JOIN t ON t.doc_id = b.doc_id AND t.i = b.i + 1)
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(batch AS INT) AS batch FROM b
""")
def token_batches(spark, d):
    chunks = chunk_rows(table(spark, d, "documents"))
    texts = chunks.select("doc_id", F.col("order_in_parent").alias("pos"), X.token_count(F.col("text")).alias("tokens"))
    return sections.token_batches(texts, BATCH_TEXTS, BATCH_TOKENS)


# -------------------------------------------------------------------- search

WORDS_SQL = """
a AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents),
words AS (SELECT id, unnest(ws) AS lexeme, unnest(range(0, len(ws))) AS pos FROM a)
"""


def doc_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("postings_df", f"WITH {WORDS_SQL} SELECT lexeme, count(DISTINCT id) AS n_docs, count(*) AS n_occurrences FROM words WHERE lexeme NOT IN ({STOP_SQL}) GROUP BY lexeme")
def postings_df(spark, d):
    return search.lexeme_statistics(search.postings(doc_texts(spark, d)))


LEXICAL_SQL = f"""{WORDS_SQL},
hit AS (SELECT id, pos, max(CASE WHEN lexeme = '{TERMS[0]}' THEN pos END) OVER w AS l0, max(CASE WHEN lexeme = '{TERMS[1]}' THEN pos END) OVER w AS l1
  FROM words WHERE lexeme IN ('{TERMS[0]}', '{TERMS[1]}') WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
cover AS (SELECT id, least(l0, l1) AS b, min(pos) AS e FROM hit WHERE l0 IS NOT NULL AND l1 IS NOT NULL GROUP BY 1, 2),
lex AS (SELECT id, round(sum(1.0::DOUBLE / (e - b)), 6) AS score FROM cover GROUP BY id)
"""


@query("lexical_scores", f"WITH {LEXICAL_SQL} SELECT * FROM lex")
def lexical_scores(spark, d):
    return search.lexical_scores(doc_texts(spark, d), TERMS)


@query("lexical_topk", f"WITH {LEXICAL_SQL} SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) - 1 AS INT) AS rank FROM lex QUALIFY rank < {LEXICAL_CANDIDATES}")
def lexical_topk(spark, d):
    return search.top_k(search.lexical_scores(doc_texts(spark, d), TERMS), LEXICAL_CANDIDATES)


@query("lexical_stemmed")
def lexical_stemmed(spark, d):
    return search.lexeme_statistics(search.stemmed(search.postings(doc_texts(spark, d))))


@query("search_chunks")
def search_chunks(spark, d):
    """A question against the stored stems of all documents."""
    index = text_index.write_text_index(doc_texts(spark, d), f"{shared_dir(spark)}/heddle/text-index-{uuid.uuid4().hex}")
    return text_index.search_chunks(index, QUESTION, LEXICAL_CANDIDATES)


#: What SQL can follow of the index: each text's positions without stop words, whatever their stems.
@query("text_index_positions", f"""
WITH {WORDS_SQL}, kept AS (SELECT * FROM words WHERE lexeme NOT IN ({", ".join(f"'{w}'" for w in text_index.STOP_WORDS)}))
SELECT id, count(*) AS n_positions, CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(min(pos) AS INT) AS first_pos, CAST(max(pos) AS INT) AS last_pos FROM kept GROUP BY id
""")
def text_index_positions(spark, d):
    index = text_index.write_text_index(doc_texts(spark, d), f"{shared_dir(spark)}/heddle/text-index-{uuid.uuid4().hex}")
    p = index.postings().select("id", F.explode("positions").alias("pos"))
    return p.groupBy("id").agg(F.count("*").alias("n_positions"), F.sum("pos").alias("pos_sum"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


VECTOR_SQL = f"""
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = {QUERY_VECTOR}),
den AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e::DOUBLE[] FROM q)), 6) AS score FROM embeddings)
"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(vectors(spark, d).where(F.col("id") == QUERY_VECTOR).first()["embedding"])


@query("dense_topk", f"WITH {VECTOR_SQL} SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) - 1 AS INT) AS rank FROM den QUALIFY rank < {DENSE_CANDIDATES}")
def dense_topk(spark, d):
    return search.top_k(search.dense_scores(vectors(spark, d), query_vector(spark, d)), DENSE_CANDIDATES)


BATCH_SQL = """
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS query_label, b.label AS label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0)
"""


def query_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the query set: those whose id is divisible by 100."""
    v = vectors(spark, d)
    return search.dense_pairs(v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), v)


@query("dense_topk_batch", f"WITH {BATCH_SQL} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INT) AS rank FROM pairs QUALIFY rank < 10")
def dense_topk_batch(spark, d):
    v = vectors(spark, d).select(F.col("id").cast("long").alias("id"), "embedding")
    return search.nearest(v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), v, 10)


@query("vector_index_topk", f"WITH {BATCH_SQL} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INT) AS rank FROM pairs QUALIFY rank < 10")
def vector_index_topk(spark, d):
    """The query set through a written index of all vectors, by bounds on the cells, so exact."""
    v = vectors(spark, d).withColumn("id", F.col("id").cast("long"))
    index = vector_index.write_index(v.select("id", "embedding"), f"{shared_dir(spark)}/heddle/vector-index-{uuid.uuid4().hex}")
    return vector_index.search(index, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), 10, probes=8, exact=True)


@query("vector_upsert", """
SELECT vec_id AS id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN label = 2 THEN -x ELSE x END), 'max') AS largest, CASE WHEN label = 2 THEN 2 ELSE 1 END AS writes FROM embeddings
""")
def vector_upsert(spark, d):
    """All vectors, then those of one label again with the signs changed: the last write of an id stays."""
    v = vectors(spark, d).select("id", "embedding", F.lit(1).alias("writes"), "label")
    size = v.select(F.size("embedding")).first()[0]
    store = vector_store.VectorTable.create(spark, f"{shared_dir(spark)}/heddle/vectors-{uuid.uuid4().hex}", size, 16)
    store.upsert(v.drop("label"), "writes")
    store.upsert(v.where("label = 2").select("id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(2).alias("writes")), "writes")
    return store.rows().select("id", F.array_max("embedding").alias("largest"), F.col("seq").cast("int").alias("writes"))


@query("similarity_pairs", f"WITH {BATCH_SQL} SELECT query_id, id, score FROM pairs WHERE label = query_label AND query_id <> id AND score >= 0.3")
def similarity_pairs(spark, d):
    label = vectors(spark, d).select("id", "label")
    found = query_pairs(spark, d).where("score >= 0.3 and query_id <> id").join(label, "id")
    return found.join(label.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id").where("label = ql").select("query_id", "id", "score")


@query("similarity_pairs_all", """
SELECT a, b, score FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score
FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE score >= 0.3
""")
def similarity_pairs_all(spark, d):
    """The whole similarity join; ``similarity_pairs`` has only the query set on one side."""
    return search.similar_pairs(vectors(spark, d), 0.3)


RANKS_SQL = f"""{VECTOR_SQL}, {LEXICAL_SQL},
r AS (SELECT 0 AS src, id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM den QUALIFY rank < {DENSE_CANDIDATES}
UNION ALL SELECT 1, id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM lex QUALIFY rank < {LEXICAL_CANDIDATES}),
fused AS (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, seen) - 1 AS INT) AS rank FROM (
SELECT id, round(sum(1.0::DOUBLE / (61 + rank)), 6) AS score, min(src * 1000 + rank) AS seen FROM r GROUP BY id))
"""


@query("rrf_fusion", f"WITH {RANKS_SQL} SELECT id, score, rank FROM fused")
def rrf_fusion(spark, d):
    return search.reciprocal_rank_fusion([dense_topk(spark, d), lexical_topk(spark, d)])


@query("hybrid_search", f"WITH {RANKS_SQL} SELECT id, score, rank, source, lang, sha256(text) AS content_hash FROM fused JOIN documents ON doc_id = id")
def hybrid_search(spark, d):
    fused = rrf_fusion(spark, d)  # at most 40 rows
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return docs.join(F.broadcast(fused), "id").select("id", "score", "rank", "source", "lang", X.sha256_hex(F.col("text")).alias("content_hash"))


RERANK_SQL = f"""{RANKS_SQL},
cand AS (SELECT rank AS input_pos, id, text, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM fused JOIN documents ON doc_id = id),
best AS (SELECT input_pos, id, text, relevance, CAST(row_number() OVER (ORDER BY relevance DESC, input_pos) - 1 AS INT) AS rank FROM (
SELECT *, round(len(list_filter(ws, lambda w: w IN ('{TERMS[0]}', '{TERMS[1]}')))::DOUBLE / greatest(len(ws), 1), 6) AS relevance FROM cand) QUALIFY rank < {TOP_K})
"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(F.broadcast(rrf_fusion(spark, d)), "id").select(F.col("rank").alias("input_pos"), "id", "text")


@query("rerank_overlap", f"WITH {RERANK_SQL} SELECT input_pos, id, relevance, rank FROM best")
def rerank_overlap(spark, d):
    return search.rerank(candidates(spark, d), search.overlap_score(TERMS), TOP_K)


@query("answer_prompt", f"""
WITH {RERANK_SQL} SELECT 'Excerpts:' || chr(10) || chr(10) || string_agg('[' || (rank + 1) || '] (' || 'chunk ' || (rank + 1) || ') ' || text, chr(10) || chr(10) ORDER BY rank)
|| chr(10) || chr(10) || 'Question: {QUESTION}' AS prompt FROM best
""")
def answer_prompt(spark, d):
    cand = materialize(candidates(spark, d), "candidates")
    top = search.rerank(cand, search.overlap_score(TERMS), TOP_K)
    none = F.lit(None).cast("string")
    return search.prompt(QUESTION, cand.join(F.broadcast(top), ["input_pos", "id"]).select("rank", "text", none.alias("clause_number"), none.alias("title")))


@query("retrieval_eval", f"""
WITH {BATCH_SQL}, top AS (SELECT query_id, id, label = query_label AS good FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10),
want AS (SELECT query_id, count(*) AS m FROM pairs WHERE label = query_label GROUP BY 1)
SELECT query_id, round(count(*) FILTER (WHERE good) / count(*)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE good) / max(m)::DOUBLE, 6) AS recall FROM top JOIN want USING (query_id) GROUP BY query_id
""")
def retrieval_eval(spark, d):
    label = vectors(spark, d).select("id", "label")
    q = label.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label")
    return evaluation.precision_recall(dense_topk_batch(spark, d), q, label)


@query("route_turns", """
SELECT CASE WHEN regexp_matches(lower(text), 'compare|difference|versus|gap|both') THEN 'loop' WHEN regexp_matches(lower(text), 'relat|depend|reference|require|map|impact') THEN 'graph' ELSE 'vector' END AS path, role, count(*) AS n
FROM conversations GROUP BY 1, 2
""")
def route_turns(spark, d):
    return table(spark, d, "conversations").groupBy(evaluation.route(F.col("text")).alias("path"), "role").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------- graph

VERTEX_SQL = f"""{STAR_SQL},
vertices AS (SELECT source_type AS entity_type, source_name AS name FROM edges UNION SELECT target_type, target_name FROM edges)
"""
KEY_SQL = ", ".join(RELATION_KEY)


@query("graph_entities", f"WITH {VERTEX_SQL} SELECT * FROM vertices")
def graph_entities(spark, d):
    return graph.fetch_entities(graph.endpoints(star_edges(spark, d)))


@query("graph_relations", f"WITH {STAR_SQL} SELECT source_type, source_name, relation_type, target_type, target_name FROM edges")
def graph_relations(spark, d):
    return graph.fetch_relations(star_edges(spark, d))


@query("document_graph", f"WITH {STAR_SQL} SELECT source_type, source_name, relation_type, target_type, target_name FROM edges WHERE document_id = '7'")
def document_graph(spark, d):
    g = graph.document_graph(star_edges(spark, d), "7")
    c = F.col
    return g.select(
        c("source.entity_type").alias("source_type"), c("source.canonical_name").alias("source_name"), "relation_type",
        c("target.entity_type").alias("target_type"), c("target.canonical_name").alias("target_name"),
    )


SEED_CHUNKS = (0, 1, 2, 3, 4)
SEED_SQL = f"""{STAR_SQL},
se AS (SELECT * FROM edges WHERE chunk_id IN {SEED_CHUNKS} AND relation_type IN ('APPLIES_TO', 'REQUIRES')),
seed AS (SELECT source_type AS t, source_name AS n FROM se UNION SELECT target_type, target_name FROM se)
"""


def seeds(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    """Entities of the question's chunks, in the order and customer part of the graph."""
    edges = star_edges(spark, d) if edges is None else edges
    chunks = spark.createDataFrame([(i,) for i in SEED_CHUNKS], "chunk_id long")
    own = edges.where(F.col("relation_type").isin("APPLIES_TO", "REQUIRES"))
    return graph.entities_for_chunks(own, F.broadcast(chunks))


@query("entities_for_chunks", f"WITH {SEED_SQL} SELECT t AS entity_type, n AS name FROM seed")
def entities_for_chunks(spark, d):
    return seeds(spark, d)


@query("relations_touching", f"WITH {SEED_SQL} SELECT DISTINCT edges.* FROM edges WHERE (source_type, source_name) IN (SELECT t, n FROM seed) OR (target_type, target_name) IN (SELECT t, n FROM seed)")
def relations_touching(spark, d):
    return graph.relations_touching(star_edges(spark, d), seeds(spark, d)).dropDuplicates(["edge_id"])


@query("relations_by_type", f"WITH {STAR_SQL} SELECT source_name, target_name, chunk_id FROM edges WHERE relation_type = 'MAPS_TO'")
def relations_by_type(spark, d):
    return graph.relations_by_type(star_edges(spark, d), "maps_to").select("source_name", "target_name", "chunk_id")


@query("what_references", f"WITH {STAR_SQL} SELECT source_type, source_name, relation_type FROM edges WHERE relation_type = 'DEFINED_IN' AND ((target_type = 'Definition' AND target_name = 'Brand#11') OR (source_type = 'Definition' AND source_name = 'Brand#11'))")
def what_references(spark, d):
    return graph.relations_by_type(star_edges(spark, d), "defined_in", ("Definition", "Brand#11")).select("source_type", "source_name", "relation_type")


HOPS_SQL = f"""
h1 AS (SELECT * FROM edges WHERE (source_type, source_name) IN (SELECT t, n FROM seed) OR (target_type, target_name) IN (SELECT t, n FROM seed)),
f1 AS ((SELECT source_type AS t, source_name AS n FROM h1 UNION SELECT target_type, target_name FROM h1) EXCEPT SELECT t, n FROM seed),
h2 AS (SELECT * FROM edges WHERE (source_type, source_name) IN (SELECT t, n FROM f1) OR (target_type, target_name) IN (SELECT t, n FROM f1)),
expanded AS (SELECT {KEY_SQL}, CAST(min(hop) AS INT) AS hop, min(document_id) AS document_id FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY {KEY_SQL})
"""
EXPAND_SQL = f"{SEED_SQL}, {HOPS_SQL}"


def expanded(spark: SparkSession, d: str, enough: int | None = None) -> DataFrame:
    edges = materialize(star_edges(spark, d), "edges")  # each hop reads it
    return graph.expand_hops(edges, seeds(spark, d, edges), enough=enough)


@query("expand_2hop", f"WITH {EXPAND_SQL} SELECT * FROM expanded")
def expand_2hop(spark, d):
    return expanded(spark, d)


FACT_SQL = f"{EXPAND_SQL}, facts AS (SELECT * FROM expanded ORDER BY hop, {KEY_SQL} LIMIT {GRAPH_FACTS})"


@query("graph_facts", f"WITH {FACT_SQL} SELECT hop, '[' || chunk_id || '] ' || source_type || ':''' || source_name || ''' --' || relation_type || '--> ' || target_type || ':''' || target_name || '''' AS fact FROM facts")
def graph_facts(spark, d):
    return graph.fact_lines(graph.capped_facts(expanded(spark, d, GRAPH_FACTS))).select("hop", "fact")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the part of chunks: the id is the chunk's."""
    doc = table(spark, d, "documents")
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return doc.select(F.col("doc_id").alias("chunk_id"), name.alias("filename"), F.lit(None).cast("string").alias("clause_number"), F.concat(F.col("source"), F.lit(".d"), F.col("doc_id").cast("string")).alias("path"))


@query("citations", f"""
WITH {FACT_SQL}, cited(chunk_id, rank) AS (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 4)),
wanted AS (SELECT * FROM cited UNION ALL SELECT DISTINCT chunk_id, NULL FROM facts WHERE chunk_id NOT IN (SELECT chunk_id FROM cited))
SELECT CAST(chunk_id AS BIGINT) AS chunk_id, source || '_' || doc_id || '.txt' AS filename, source || '.d' || doc_id AS path, CAST(rank AS INT) AS rank FROM wanted JOIN documents ON doc_id = chunk_id
""")
def citations(spark, d):
    cited = spark.createDataFrame([(c, i) for i, c in enumerate(SEED_CHUNKS)], "chunk_id long, rank int")
    return graph.citations(cited, graph.capped_facts(expanded(spark, d, GRAPH_FACTS)), document_chunks(spark, d)).drop("clause_number")


WEIGHT_SQL = f"""{STAR_SQL},
weights AS (SELECT least((source_type, source_name), (target_type, target_name)) AS a, greatest((source_type, source_name), (target_type, target_name)) AS b, count(*) AS weight
FROM edges WHERE (source_type, source_name) <> (target_type, target_name) GROUP BY 1, 2)
"""


@query("edge_weights", f"""
WITH {STAR_SQL}, p AS (SELECT source_type || chr(1) || source_name AS s, target_type || chr(1) || target_name AS t FROM edges),
w AS (SELECT least(s, t) AS a, greatest(s, t) AS b, count(*) AS weight FROM p WHERE s <> t GROUP BY 1, 2)
SELECT split_part(a, chr(1), 1) AS a_type, split_part(a, chr(1), 2) AS a_name, split_part(b, chr(1), 1) AS b_type, split_part(b, chr(1), 2) AS b_name, weight FROM w
""")
def edge_weights(spark, d):
    return graph.edge_weights(star_edges(spark, d))


@query("connected_components", """
SELECT 'c' || o_custkey AS node, 'c' || o_custkey AS component FROM orders GROUP BY o_custkey
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
""")
def connected_components(spark, d):
    orders = table(spark, d, "orders")
    return connected(orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("b")))


def graph_weights(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph as ``(a, b, weight)``."""
    w = graph.edge_weights(star_edges(spark, d))
    return w.select(F.concat_ws(":", "a_type", "a_name").alias("a"), F.concat_ws(":", "b_type", "b_name").alias("b"), "weight")


@query("communities")
def communities(spark, d):
    return community.community_table(community.detect_communities(graph_weights(spark, d), least_gain=1e-3))


def published_communities(spark: SparkSession, d: str) -> community_job.Communities:
    """Customers and their nations, detected, summarised and published."""
    edges = star_edges(spark, d).where("relation_type = 'PART_OF' and source_type = 'Asset'")
    w = graph.edge_weights(edges).select(F.concat_ws(":", "a_type", "a_name").alias("a"), F.concat_ws(":", "b_type", "b_name").alias("b"), "weight")
    store = community_job.Communities(spark, f"{shared_dir(spark)}/heddle/communities-{uuid.uuid4().hex}")
    store.publish(community.detect_communities(w), edges)
    return store


NATION_SQL = "own AS (SELECT n_nationkey, n_name, min('Asset:' || c_custkey) AS community, count(*) AS n, min(c_custkey || ' (Asset)') AS title FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"


@query("published_members", f"""
WITH {NATION_SQL} SELECT community, 'Clause' AS entity_type, n_name AS name FROM own UNION ALL SELECT community, 'Asset', CAST(c_custkey AS VARCHAR) FROM customer JOIN own ON n_nationkey = c_nationkey
""")
def published_members(spark, d):
    return published_communities(spark, d).members()


@query("published_communities", f"WITH {NATION_SQL} SELECT community, 1 + n AS entity_count, title, (1 + 2 * n) || ' entities and relations' AS summary FROM own")
def published_community_rows(spark, d):
    return published_communities(spark, d).communities()


@query("community_build_summary", """
SELECT count(*) FILTER (WHERE n >= 2) AS communities_created, count(*) FILTER (WHERE n < 2) AS singleton_communities_skipped FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
""")
def community_build_summary(spark, d):
    c = table(spark, d, "customer")
    return community.build_summary(c.select(F.col("c_custkey").alias("node"), F.struct("c_nationkey", "c_mktsegment").alias("community")))


@query("community_sizes", """
SELECT c_nationkey AS community, count(*) AS entity_count, CAST(row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS INT) AS place FROM customer GROUP BY 1 HAVING count(*) >= 2
""")
def community_sizes(spark, d):
    member = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    return community.rank_sizes(community.community_table(member)).select("community", "entity_count", "place")


@query("modularity", """
WITH w AS (SELECT p_partkey AS p, p_brand AS brand, 'b' || p_brand AS v FROM part UNION ALL SELECT p_partkey, p_brand, 't' || p_type FROM part),
m AS (SELECT 'b' || p_brand AS node, p_brand AS c FROM part GROUP BY p_brand UNION ALL SELECT 't' || p_type, p_type FROM part GROUP BY p_type),
e AS (SELECT w.brand AS ca, m.c AS cb FROM w JOIN m ON m.node = w.v),
deg AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY c),
tot AS (SELECT count(*)::DOUBLE AS t, count(*) FILTER (WHERE ca = cb) AS i FROM e)
SELECT round(max(i) / max(t) - sum(d::DOUBLE * d) / (4 * max(t) * max(t)), 6) AS modularity FROM deg, tot
""")
def modularity(spark, d):
    part = table(spark, d, "part")
    c = F.col
    node = F.concat(F.lit("p"), c("p_partkey").cast("string"))
    w = part.select(node.alias("a"), F.concat(F.lit("b"), c("p_brand")).alias("b"), F.lit(1).alias("weight")).union(part.select(node, F.concat(F.lit("t"), c("p_type")), F.lit(1)))
    m = part.select(node.alias("node"), c("p_brand").alias("community"))
    m = m.union(part.select(F.concat(F.lit("b"), c("p_brand")), "p_brand").distinct()).union(part.select(F.concat(F.lit("t"), c("p_type")), "p_type").distinct())
    return community.modularity(w, m)


@query("community_text", """
WITH m AS (SELECT n_regionkey AS community, 'Clause' AS entity_type, n_name AS name FROM nation UNION ALL SELECT r_regionkey, 'Standard', r_name FROM region),
e AS (SELECT community, string_agg('- ' || name || ' (' || entity_type || ')', chr(10) ORDER BY '- ' || name || ' (' || entity_type || ')') AS es FROM m GROUP BY 1),
r AS (SELECT n_regionkey AS community, string_agg('- ' || n_name || ' PART_OF ' || r_name, chr(10) ORDER BY '- ' || n_name || ' PART_OF ' || r_name) AS rs FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1)
SELECT e.community, 'Entities:' || chr(10) || es || coalesce(chr(10) || chr(10) || 'Relations:' || chr(10) || rs, '') AS text FROM e LEFT JOIN r USING (community)
""")
def community_text(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    m = nation.select(F.col("n_regionkey").alias("community"), F.lit("Clause").alias("entity_type"), F.col("n_name").alias("name"))
    m = m.union(region.select("r_regionkey", F.lit("Standard"), "r_name"))
    edges = star_edges(spark, d).where((F.col("relation_type") == "PART_OF") & (F.col("source_type") == "Clause"))
    return community.community_text(m, edges)


@query("global_search", """
WITH c AS (SELECT label, list(embedding::DOUBLE[] ORDER BY vec_id) AS es, count(*) AS n FROM embeddings GROUP BY label),
m AS (SELECT label, n, [list_sum(list_transform(es, lambda e: e[i])) / n for i in range(1, len(es[1]) + 1)] AS centre FROM c)
SELECT label AS id, n AS entity_count, round(list_cosine_similarity(centre, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM m
""")
def global_search(spark, d):
    v = vectors(spark, d)
    parts = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    centre = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs"), F.max("n").alias("entity_count"))
    centre = centre.select(F.col("label").alias("id"), "entity_count", F.transform("xs", lambda p: p["x"]).alias("embedding"))
    return centre.join(search.dense_scores(centre, query_vector(spark, d)), "id").select("id", "entity_count", "score")


@query("gap_analysis", f"""
WITH {STAR_SQL} SELECT target_type, target_name FROM edges WHERE relation_type = 'MAPS_TO' AND source_name = '0'
EXCEPT SELECT target_type, target_name FROM edges WHERE relation_type = 'MAPS_TO' AND source_name = '1'
""")
def gap_analysis(spark, d):
    return graph.gap(star_edges(spark, d), "MAPS_TO", ("Standard", "1"), ("Standard", "0"))


@query("impact_downstream", f"""
WITH {STAR_SQL}, h1 AS (SELECT DISTINCT target_type AS t, target_name AS n FROM edges WHERE source_type = 'Process' AND source_name = '1'),
h2 AS (SELECT DISTINCT target_type AS t, target_name AS n FROM edges WHERE (source_type, source_name) IN (SELECT t, n FROM h1)),
h3 AS (SELECT DISTINCT target_type AS t, target_name AS n FROM edges WHERE (source_type, source_name) IN (SELECT t, n FROM h2))
SELECT t AS entity_type, n AS name, CAST(min(h) AS INT) AS hop FROM (SELECT *, 1 AS h FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY 1, 2
""")
def impact_downstream(spark, d):
    return graph.impact(star_edges(spark, d), spark.createDataFrame([("Process", "1")], "entity_type string, name string"), 3)


@query("drop_documents", f"""
WITH {STAR_SQL}, kept AS (SELECT * FROM edges WHERE document_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0))
SELECT relation_type, count(*) AS n_edges FROM kept GROUP BY 1
""")
def drop_documents(spark, d):
    edges = star_edges(spark, d)
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("document_id"))
    left, _ = graph.drop_documents(edges, graph.endpoints(edges), gone)
    return left.groupBy("relation_type").agg(F.count("*").alias("n_edges"))


@query("constraint_violations", """
WITH v AS (SELECT 'Asset' AS entity_type, c_mktsegment AS name FROM customer UNION ALL SELECT 'Control', p_name FROM part UNION ALL SELECT 'Role', s_name FROM supplier UNION ALL SELECT 'Event', event_type FROM events)
SELECT entity_type, name, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) > 1 OR entity_type = 'Event'
""")
def constraint_violations(spark, d):
    """Names that would break the graph's constraints if each row became a vertex."""
    named = [("customer", "Asset", "c_mktsegment"), ("part", "Control", "p_name"), ("supplier", "Role", "s_name"), ("events", "Event", "event_type")]
    rows = [table(spark, d, t).select(F.lit(kind).alias("entity_type"), F.col(c).alias("name")) for t, kind, c in named]
    return graph.violations(reduce(DataFrame.union, rows))


@query("bridge_edges", """
WITH b AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)
SELECT CAST(a AS INT) AS shard_a, CAST(b AS INT) AS shard_b, n FROM b
""")
def bridge_edges(spark, d):
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    owner = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    both = lines.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).where("s_nationkey <> c_nationkey")
    return both.groupBy(F.col("s_nationkey").alias("shard_a"), F.col("c_nationkey").alias("shard_b")).agg(F.count("*").alias("n"))


# -------------------------------------------------- extraction and resolution

RULE_SQL = f"""{CHUNK_SQL},
kinds AS (SELECT ['Standard', 'Clause', 'Control', 'Requirement', 'Risk', 'Asset', 'Process', 'Role', 'Definition'] AS k),
ents AS (SELECT chunk_id, doc_id, name, k[1 + CAST(('0x' || substr(md5(name), 1, 4))::INT % 9 AS INT)] AS entity_type
FROM (SELECT chunk_id, doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{4,}}'))) AS name FROM chunk), kinds)
"""


def document_extractions(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunk_rows(table(spark, d, "documents"))
    empty = spark.createDataFrame([], "content_hash string")
    return extraction.cached_extractions(chunks, extraction.extract_missing(chunks, empty))


@query("extract_rules", f"WITH {RULE_SQL} SELECT chunk_id, doc_id, name, entity_type FROM ents")
def extract_rules(spark, d):
    return document_extractions(spark, d).select("chunk_id", "doc_id", "name", "entity_type")


@query("extract_cache_misses", f"""
WITH {CHUNK_SQL} SELECT sha256(text) AS content_hash, count(*) AS n_chunks FROM chunk WHERE text NOT IN (SELECT text FROM chunk WHERE lang = 'en') GROUP BY 1
""")
def extract_cache_misses(spark, d):
    chunks = chunk_rows(table(spark, d, "documents"))
    cache = chunks.where("lang = 'en'").select(X.sha256_hex(F.col("text")).alias("content_hash")).distinct()
    missing = extraction.extract_missing(chunks, cache).select("content_hash")
    counts = chunks.groupBy(X.sha256_hex(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n_chunks"))
    return counts.join(missing, "content_hash", "left_semi")


@query("validate_extractions", f"""
WITH {RULE_SQL}, n AS (SELECT chunk_id, count(*) AS n FROM ents GROUP BY 1)
SELECT chunk_id, coalesce(n, 0) < 2 OR order_in_parent % 3 = 0 AS valid FROM chunk LEFT JOIN n USING (chunk_id)
""")
def validate_extractions(spark, d):
    """The default extractions of all chunks as JSON; of three chunks one has an unknown end, one an unknown relation, if it has a relation."""
    c = chunk_rows(table(spark, d, "documents"))
    e = c.select("chunk_id", "order_in_parent", extraction.rule_extraction(F.col("text")).alias("entities"))
    kind = F.col("order_in_parent") % 3
    relations = F.transform(
        extraction.rule_relations(F.col("entities")),
        lambda r: F.struct(r["source"].alias("source"), F.when(kind == 2, "eats").otherwise(r["relation_type"]).alias("relation_type"), F.when(kind == 1, "nobody").otherwise(r["target"]).alias("target")),
    )
    payload = F.to_json(F.struct("entities", relations.alias("relations")))
    return e.select("chunk_id", extraction.is_valid(extraction.parse_extraction(payload)).alias("valid"))


NORM = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
RESOLVE_SQL = f"""{RULE_SQL},
g AS (SELECT {NORM.format('name')} AS key, entity_type, count(*) AS n_mentions, count(DISTINCT name) AS n_names, arg_min(name, (doc_id, CAST(split_part(chunk_id, ':', 2) AS INT), name)) AS canonical_name FROM ents GROUP BY 1, 2),
old AS (SELECT {NORM.format('p_name')} AS key, max(p_name) AS p_name FROM part GROUP BY 1)
"""


def candidate_entities(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("doc_id", F.split("chunk_id", ":")[1].cast("int").alias("n"), "name")
    return document_extractions(spark, d).select(order.alias("pos"), "name", "entity_type")


@query("resolve_exact", f"WITH {RESOLVE_SQL} SELECT key, entity_type, canonical_name, n_mentions, n_names FROM g")
def resolve_exact(spark, d):
    return extraction.group_exact(candidate_entities(spark, d)).select("key", "entity_type", "canonical_name", "n_mentions", F.size("source_names").cast("long").alias("n_names"))


@query("resolve_existing", """
WITH c AS (SELECT c_custkey AS pos, c_mktsegment AS name, 'Asset' AS entity_type FROM customer UNION ALL SELECT p_partkey, p_type, 'Control' FROM part),
g AS (SELECT lower(name) AS key, entity_type, count(*) AS n_mentions FROM c GROUP BY 1, 2), o AS (SELECT lower(p_type) AS key, 'Control' AS entity_type, upper(p_type) AS name FROM part GROUP BY p_type)
SELECT g.key, g.entity_type, n_mentions, o.key IS NULL AS is_new, coalesce(o.name, (SELECT min(name) FROM c WHERE lower(c.name) = g.key)) AS canonical_name FROM g LEFT JOIN o ON o.key = g.key AND o.entity_type = g.entity_type
""")
def resolve_existing(spark, d):
    customer, part = table(spark, d, "customer"), table(spark, d, "part")
    c = customer.select(F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("name"), F.lit("Asset").alias("entity_type"))
    c = c.union(part.select("p_partkey", "p_type", F.lit("Control")))
    old = part.groupBy("p_type").agg(F.min("p_partkey").alias("pos")).select(F.upper("p_type").alias("name"), F.lit("Control").alias("entity_type"), "pos")
    return extraction.match_exact(extraction.group_exact(c), old).select("key", "entity_type", "n_mentions", "is_new", "canonical_name")


@query("resolve_similar", f"""
WITH {BATCH_SQL} SELECT query_id AS pos, query_label AS label, 'v' || id AS existing_name, score FROM pairs WHERE label = query_label AND id <> query_id AND id % 100 <> 0 AND score >= 0.2
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1
""")
def resolve_similar(spark, d):
    v = vectors(spark, d).withColumn("entity_type", F.col("label").cast("string"))
    new = v.where("id % 100 = 0").select(F.col("id").alias("pos"), "entity_type", "embedding")
    old = v.where("id % 100 <> 0").select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), "entity_type", F.col("id").alias("pos"), "embedding")
    return extraction.match_similar(new, old, 0.2).select("pos", F.col("entity_type").cast("int").alias("label"), "existing_name", "score")


@query("resolve_greedy")
def resolve_greedy(spark, d):
    v = vectors(spark, d).select(F.col("id").cast("long").alias("pos"), F.col("label").cast("string").alias("entity_type"), "embedding")
    return extraction.absorb_greedily(v, 0.35)


def loaded_sql(k: int, which: str, before: str) -> str:
    """Tables of the load number ``k``, of the documents ``which``, into a graph of the vertices ``before``: ``s`` the groups, ``v`` the vertices, ``ed`` the edges."""
    cosine = "round(list_cosine_similarity({0}, {1}), 6)"
    return f"""
c{k} AS (SELECT *, {NORM.format('name')} AS key FROM cand WHERE {which}),
g{k} AS (SELECT key, entity_type, arg_min(name, (doc_id, ord, k)) AS name, min((doc_id, ord, k)) AS pos FROM c{k} GROUP BY ALL),
o{k} AS (SELECT {NORM.format('name')} AS key, entity_type, max(name) AS old FROM {before} GROUP BY ALL),
x{k} AS (SELECT g{k}.*, old FROM g{k} LEFT JOIN o{k} USING (key, entity_type)),
u{k} AS MATERIALIZED (SELECT *, {LETTER_SQL} AS e FROM x{k} WHERE old IS NULL),
m{k} AS MATERIALIZED (SELECT * FROM (SELECT u.pos, b.name AS old, {cosine.format('u.e', 'b.e')} AS score FROM u{k} u JOIN (SELECT *, {LETTER_SQL} AS e FROM {before}) b USING (entity_type)) WHERE score >= 0.9
  QUALIFY row_number() OVER (PARTITION BY pos ORDER BY score DESC, old) = 1),
r{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY pos) AS n FROM u{k} WHERE pos NOT IN (SELECT pos FROM m{k})),
l{k} AS MATERIALIZED (SELECT entity_type, b.n, list(a.n) AS earlier FROM r{k} a JOIN r{k} b USING (entity_type) WHERE a.n < b.n AND {cosine.format('a.e', 'b.e')} >= 0.9 GROUP BY ALL),
w{k} AS (SELECT DISTINCT entity_type, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS leaders FROM r{k}
  UNION ALL SELECT w{k}.entity_type, r.n, CASE WHEN list_has_any(leaders, earlier) THEN leaders ELSE list_append(leaders, r.n) END
  FROM w{k} JOIN r{k} r ON r.entity_type = w{k}.entity_type AND r.n = w{k}.n + 1 LEFT JOIN l{k} l ON l.entity_type = r.entity_type AND l.n = r.n),
f{k} AS MATERIALIZED (SELECT entity_type, arg_max(leaders, n) AS leaders FROM w{k} GROUP BY 1),
a{k} AS (SELECT r.key, r.entity_type, coalesce(list_min(list_intersect(l.earlier, f.leaders)), r.n) AS n FROM r{k} r JOIN f{k} f USING (entity_type) LEFT JOIN l{k} l ON l.entity_type = r.entity_type AND l.n = r.n),
s{k} AS MATERIALIZED (SELECT key, entity_type, pos, old AS name, false AS late, false AS is_new FROM x{k} WHERE old IS NOT NULL
  UNION ALL SELECT u.key, u.entity_type, u.pos, m.old, true, false FROM u{k} u JOIN m{k} m USING (pos)
  UNION ALL SELECT a.key, a.entity_type, r.pos, r.name, true, true FROM a{k} a JOIN r{k} r ON r.entity_type = a.entity_type AND r.n = a.n),
v{k} AS MATERIALIZED (SELECT entity_type, name FROM {before} UNION SELECT entity_type, name FROM s{k} WHERE is_new),
raw{k} AS (SELECT c.name AS raw, arg_max(s.name, (late, s.pos)) AS name FROM c{k} c JOIN s{k} s USING (key, entity_type) GROUP BY 1),
kind{k} AS (SELECT name, arg_max(entity_type, (late, pos)) AS entity_type FROM s{k} GROUP BY 1),
end{k} AS MATERIALIZED (SELECT raw, name, entity_type FROM raw{k} JOIN kind{k} USING (name)),
ed{k} AS (SELECT a.entity_type AS source_type, a.name AS source_name, upper(relation_type) AS relation_type, b.entity_type AS target_type, b.name AS target_name, chunk_id, doc_id FROM mention JOIN end{k} a ON a.raw = source JOIN end{k} b ON b.raw = target WHERE {which})
"""


LETTER_SQL = "[" + ", ".join(f"CAST(length(name) - length(replace(lower(name), '{chr(c)}', '')) AS DOUBLE)" for c in range(97, 123)) + "]"
LOAD_SQL = f"""WITH RECURSIVE {CHUNK_SQL},
hit AS (SELECT chunk_id, doc_id, lang, order_in_parent AS ord, unnest(l) AS name, unnest(range(len(l))) AS i FROM (SELECT *, regexp_extract_all(text, '[A-Z][a-z]{{4,}}') AS l FROM chunk)),
cand AS MATERIALIZED (SELECT *, {list(ENTITY_TYPES)}[1 + CAST(('0x' || substr(md5(name), 1, 4))::INT % 9 AS INT)] AS entity_type
  FROM (SELECT chunk_id, doc_id, lang, ord, name, row_number() OVER (PARTITION BY chunk_id ORDER BY min(i)) - 1 AS k FROM hit GROUP BY chunk_id, doc_id, lang, ord, name)),
mention AS MATERIALIZED (SELECT a.chunk_id, a.doc_id, a.lang, a.name AS source, b.name AS target, {list(RELATION_TYPES)}[1 + CAST(('0x' || substr(md5(a.name || b.name), 1, 4))::INT % 9 AS INT)] AS relation_type
  FROM cand a JOIN cand b ON b.chunk_id = a.chunk_id AND b.k = a.k + 1),
v0 AS (SELECT '' AS entity_type, '' AS name WHERE false),
{loaded_sql(1, "lang = 'en'", 'v0')},
{loaded_sql(2, 'true', 'v1')}
"""


def load_batch(store: resolution.StoredGraph, docs: DataFrame) -> DataFrame:
    """Extracts by the default rule, each content once, and loads the documents."""
    chunks = chunk_rows(docs)
    cache = materialize(extraction.extract_missing(chunks, docs.sparkSession.createDataFrame([], "content_hash string")), "extractions")
    hashed = chunks.select("chunk_id", "doc_id", "order_in_parent", X.sha256_hex(F.col("text")).alias("content_hash"))
    found = hashed.join(cache, "content_hash")
    each = found.select("doc_id", "order_in_parent", F.posexplode("entities").alias("k", "e"))
    pos = F.format_string("%019d:%010d:%010d", "doc_id", "order_in_parent", "k")
    mentions = found.select("chunk_id", F.col("doc_id").cast("string").alias("document_id"), F.explode(extraction.rule_relations(F.col("entities"))).alias("r"))
    return resolution.resolve_and_load(
        store,
        docs.select(F.col("doc_id").cast("string").alias("document_id")),
        each.select(pos.alias("pos"), "e.name", "e.entity_type"),
        mentions.select("r.*", "chunk_id", "document_id"),
        lambda names: names.select("pos", X.letter_counts(F.col("name")).alias("embedding")),
    )


def loaded_graph(spark: SparkSession, d: str) -> resolution.StoredGraph:
    """The documents' graph after two loads: one language first, then all, whose first part is loaded again."""
    docs = table(spark, d, "documents")
    store = resolution.StoredGraph(spark, f"{shared_dir(spark)}/heddle/graph-{uuid.uuid4().hex}", 16)
    load_batch(store, docs.where("lang = 'en'"))
    load_batch(store, docs)
    return store


@query("resolve_and_load", f"{LOAD_SQL} SELECT source_type, source_name, relation_type, target_type, target_name, count(*) AS n_mentions FROM ed2 GROUP BY ALL")
def resolve_and_load(spark, d):
    edges = loaded_graph(spark, d).edges()
    return edges.groupBy("source_type", "source_name", "relation_type", "target_type", "target_name").agg(F.count("*").alias("n_mentions"))


@query("resolved_vertices", f"{LOAD_SQL} SELECT entity_type, name FROM v2")
def resolved_vertices(spark, d):
    return loaded_graph(spark, d).vertices().select("entity_type", "name")


UPKEPT_SQL = LOAD_SQL[: LOAD_SQL.index("v0 AS")].rstrip().rstrip(",").replace("FROM documents", "FROM final_docs")


def document_changes(spark: SparkSession, d: str, landing: str, step: int) -> None:
    """Lands the changes number ``step``: all documents, then those of one language deleted, then one source cut to first lines, and late news of the deleted."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "source", "lang", "text")
    change = lambda rows, seq, deleted, text="text": rows.select("document_id", F.lit(seq).cast("long").alias("seq"), F.lit(deleted).alias("deleted"), "source", "lang", F.expr(text).alias("text"))
    if step == 1:
        rows = change(docs, 10, False).unionByName(change(docs.where("lang = 'en'"), 5, False, "'Older Words'"))
    elif step == 2:
        rows = change(docs.where("lang = 'de'"), 20, True, "cast(null as string)")
    else:
        rows = change(docs.where("lang <> 'de' and source = 'src2'"), 30, False, "substring_index(text, '\\n', 1)").unionByName(change(docs.where("lang = 'de'"), 15, False))
    rows.write.mode("append").parquet(landing)


def upkept_graph(spark: SparkSession, d: str) -> resolution.StoredGraph:
    """The documents' graph, kept by a stream over three lots of changes."""
    base = f"{shared_dir(spark)}/heddle/upkeep-{uuid.uuid4().hex}"
    store = resolution.StoredGraph(spark, f"{base}/graph", 16)

    def extract(docs: DataFrame) -> DataFrame:
        chunks = chunk_rows(docs.withColumnRenamed("document_id", "doc_id"))
        each = chunks.select("chunk_id", F.col("doc_id").alias("document_id"), extraction.rule_extraction(F.col("text")).alias("es"))
        kind = F.map_from_entries(F.transform("es", lambda e: F.struct(e["name"], e["entity_type"])))
        r = each.select("chunk_id", "document_id", kind.alias("kind"), F.explode(extraction.rule_relations(F.col("es"))).alias("r"))
        at = lambda end: F.element_at("kind", F.col(f"r.{end}"))
        return r.select(
            at("source").alias("source_type"), F.col("r.source").alias("source_name"), F.upper("r.relation_type").alias("relation_type"),
            at("target").alias("target_type"), F.col("r.target").alias("target_name"), "chunk_id", "document_id",
        )

    for step in (1, 2, 3):
        document_changes(spark, d, f"{base}/landing", step)
        upkeep.start(spark, f"{base}/landing", store, f"{base}/checkpoint", upkeep.plain_load(extract)).awaitTermination()
    return store


@query("graph_upkeep", f"""
WITH RECURSIVE final_docs AS (SELECT doc_id, source, lang, CASE WHEN source = 'src2' THEN split_part(text, chr(10), 1) ELSE text END AS text FROM documents WHERE lang <> 'de'),
{UPKEPT_SQL.removeprefix("WITH RECURSIVE ")},
e AS (SELECT s.entity_type AS st, source AS sn, t.entity_type AS tt, target AS tn FROM mention m JOIN cand s ON s.chunk_id = m.chunk_id AND s.name = m.source JOIN cand t ON t.chunk_id = m.chunk_id AND t.name = m.target)
SELECT entity_type, name, count(*) AS n_ends FROM (SELECT st AS entity_type, sn AS name FROM e UNION ALL SELECT tt, tn FROM e) GROUP BY ALL
""")
def graph_upkeep(spark, d):
    """The vertices that are left, and how many ends of edges each has."""
    store = upkept_graph(spark, d)
    counted = graph.ends(store.edges()).groupBy("entity_type", "name").agg(F.count("*").alias("n_ends"))
    return store.vertices().select("entity_type", "name").join(counted, ["entity_type", "name"], "left").select("entity_type", "name", F.coalesce("n_ends", F.lit(0)).alias("n_ends"))


@query("normalize_names", f"WITH n AS (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier) SELECT name, {NORM.format('name')} AS key FROM n")
def normalize_names(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).union(table(spark, d, "customer").select("c_name")).union(table(spark, d, "supplier").select("s_name")).distinct()
    return names.select("name", X.normalize_name(F.col("name")).alias("key"))


@query("upsert_entities", """
SELECT label AS entity_type, name, first_id FROM (SELECT label, 'e' || (vec_id % 50) AS name, min(vec_id) AS first_id FROM embeddings GROUP BY 1, 2)
""")
def upsert_entities(spark, d):
    v = vectors(spark, d)
    rows = v.select(F.col("label").alias("entity_type"), F.concat(F.lit("e"), (F.col("id") % 50).cast("string")).alias("name"), F.col("id").alias("embedding"), F.col("id").alias("pos"))
    # two batches, the earlier ids first
    half = rows.agg(F.expr("percentile_approx(pos, 0.5)").alias("h")).first()["h"]
    none = rows.select("entity_type", "name", "embedding").where("false")
    first = materialize(graph.upsert_entities(none, rows.where(F.col("pos") <= half)), "vertices")
    return graph.upsert_entities(first, rows.where(F.col("pos") > half)).select("entity_type", "name", F.col("embedding").alias("first_id"))


@query("load_edges", """
SELECT 'Asset' AS source_type, c_mktsegment AS source_name, 'PART_OF' AS relation_type, 'Clause' AS target_type, n_name AS target_name, c_custkey AS chunk_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0
""")
def load_edges(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    raw = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    mention = customer.select(raw.alias("source"), F.lit("part_of").alias("relation_type"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"), F.col("c_custkey").alias("chunk_id"), F.lit("d").alias("document_id"))
    names = customer.where("c_acctbal >= 0").select(raw.alias("raw_name"), F.lit("Asset").alias("entity_type"), F.col("c_mktsegment").alias("canonical_name"))
    names = names.union(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.lit("Clause"), "n_name"))
    return graph.load_edges(mention, names).drop("document_id")


@query("eval_regressions", """
WITH b AS (SELECT event_type AS question, avg(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT event_type AS question, avg(value) AS s FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT question, round(a.s - b.s, 4) AS change FROM b JOIN a USING (question) WHERE b.s - a.s > -1000000
""")
def eval_regressions(spark, d):
    e = table(spark, d, "events")
    run = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("question")).agg(F.avg("value").alias("score"))
    return evaluation.regressions(run(0), run(1), -1_000_000.0).select("question", F.round("change", 4).alias("change"))


ASKED_SQL = f"""{RERANK_SQL}, {STAR_SQL},
seed AS (SELECT source_type AS t, source_name AS n FROM edges WHERE chunk_id IN (SELECT id FROM best) UNION SELECT target_type, target_name FROM edges WHERE chunk_id IN (SELECT id FROM best)),
{HOPS_SQL},
facts AS (SELECT *, row_number() OVER (ORDER BY hop, {KEY_SQL}) - 1 AS place FROM expanded ORDER BY hop, {KEY_SQL} LIMIT {GRAPH_FACTS}),
ch AS (SELECT doc_id AS chunk_id, source || '_' || doc_id || '.txt' AS filename, {CLAUSE_SQL.format('text')} AS clause_number, source AS title, source || '.d' || doc_id AS path, text FROM documents),
wanted AS (SELECT id AS chunk_id, -1 AS place, rank FROM best UNION ALL SELECT chunk_id, min(place), NULL FROM facts WHERE chunk_id NOT IN (SELECT id FROM best) GROUP BY chunk_id),
cit AS (SELECT CAST(row_number() OVER (ORDER BY place, rank, chunk_id) AS INT) AS ordinal, CAST(chunk_id AS BIGINT) AS chunk_id, filename, clause_number, path, CAST(rank AS INT) AS rank FROM wanted JOIN ch USING (chunk_id)),
shown AS (SELECT CAST(place AS INT) AS place, '[' || coalesce(clause_number, CAST(chunk_id AS VARCHAR)) || '] ' || source_type || ':''' || source_name || ''' --' || relation_type || '--> ' || target_type || ':''' || target_name || '''' AS fact
  FROM facts JOIN cit USING (chunk_id)),
top AS (SELECT best.rank, '[' || (best.rank + 1) || '] (' || coalesce(clause_number, title) || ') ' || ch.text AS excerpt FROM best JOIN ch ON ch.chunk_id = best.id)
"""


def answered(spark: SparkSession, d: str) -> answer.Answered:
    """The question end to end over documents as chunks and the whole derived graph."""
    docs = document_chunks(spark, d).drop("clause_number").join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("title")), "chunk_id")
    chunks = docs.withColumn("clause_number", X.clause_number(F.col("text")))
    edges = materialize(star_edges(spark, d), "edges")
    return answer.answer_question(QUESTION, [dense_topk(spark, d), lexical_topk(spark, d)], chunks, edges, search.overlap_score(TERMS))


@query("question_to_answer", f"""
WITH {ASKED_SQL}, prompt AS (SELECT 'Excerpts:' || chr(10) || chr(10) || (SELECT string_agg(excerpt, chr(10) || chr(10) ORDER BY rank) FROM top)
|| coalesce(chr(10) || chr(10) || 'Graph-derived facts:' || chr(10) || chr(10) || (SELECT string_agg(fact, chr(10) ORDER BY place) FROM shown), '') || chr(10) || chr(10) || 'Question: {QUESTION}' AS prompt)
SELECT '{QUESTION}' AS question, sha256(prompt) AS prompt_sha256,
(SELECT array_to_string(string_split(split_part(substr(excerpt, 5), chr(10) || chr(10), 1), ' ')[:1024], ' ') FROM top WHERE rank = 0) AS answer,
(SELECT count(*) FROM shown) AS n_facts FROM prompt
""")
def question_to_answer(spark, d):
    found = answered(spark, d)
    return found.answer.select("question", X.sha256_hex(F.col("prompt")).alias("prompt_sha256"), "answer", F.lit(found.facts.count()).cast("long").alias("n_facts"))


@query("answer_citations", f"WITH {ASKED_SQL} SELECT * FROM cit")
def answer_citations(spark, d):
    return answered(spark, d).citations


@query("answer_facts", f"WITH {ASKED_SQL} SELECT place, fact FROM shown")
def answer_facts(spark, d):
    return answered(spark, d).facts.select("place", "fact")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A question end to end: hybrid search, top documents, their entities, two hops, capped facts with labels."""
    top = search.rerank(candidates(spark, d), search.overlap_score(TERMS), TOP_K)
    edges = materialize(star_edges(spark, d), "edges")
    found = graph.entities_for_chunks(edges.where(F.col("relation_type").isin("APPLIES_TO", "REQUIRES")), top.select(F.col("id").alias("chunk_id")))
    facts = graph.fact_lines(graph.capped_facts(graph.expand_hops(edges, found, enough=GRAPH_FACTS)))
    return facts.select("hop", "fact", "source_type", "source_name", "relation_type", "target_type", "target_name", "chunk_id", "document_id")


@query("question_to_facts")
def question_to_facts(spark, d):
    return flagship(spark, d)
