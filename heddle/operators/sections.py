"""Heading trees, flat: one row for each heading, in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as X

#: Parts of a page that hold no section text, elements that end a paragraph, and the named characters that are decoded.
HIDDEN = ("head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form")
BLOCKS = (
    "address", "article", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "header", "hr", "html", "li", "main", "ol", "p", "pre",
    "section", "table", "td", "th", "tr", "ul",
)
CHARACTERS = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
#: Marks of a heading's begin and of a block's bounds, characters that no page needs.
HEADING, BOUND = "\x01", "\x02"
#: In order: what is replaced, by what.
REWRITES = (
    ("(?is)<!--.*?-->" + "".join(f"|<{t}\\b[^>]*>.*?</{t}\\s*>" for t in HIDDEN), BOUND),
    ("[\x01\x02]", BOUND),
    ("\\s+", " "),
    *((f"(?i)<h{n}\\b[^>]*>", f"{BOUND}{HEADING}{n}") for n in range(1, 7)),
    ("(?i)</?(?:h[1-6]|" + "|".join(BLOCKS) + ")\\b[^>]*>", BOUND),
    ("<[/!?a-zA-Z][^>]*>", ""),
)


def heading_tree(headings: DataFrame) -> DataFrame:
    """Adds ``parent_pos`` to ``(doc_id, pos, level, ...)``: the last earlier heading of a smaller level; null under the root.

    One fold over each document's headings with an array of the last position
    of each level, so linear in them; a document's headings are a bounded group.
    """
    rows = headings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "level"))).alias("hs"))
    start = F.struct(
        F.array().cast("array<struct<pos:int,level:int>>").alias("stack"), F.array().cast("array<struct<pos:int,parent_pos:int>>").alias("out")
    )

    def step(acc: Column, h: Column) -> Column:
        open_ = F.filter(acc["stack"], lambda s: s["level"] < h["level"])
        parent = F.get(F.reverse(open_), 0)["pos"]
        return F.struct(
            F.array_append(open_, F.struct(h["pos"].cast("int").alias("pos"), h["level"].cast("int").alias("level"))).alias("stack"),
            F.array_append(acc["out"], F.struct(h["pos"].cast("int").alias("pos"), parent.alias("parent_pos"))).alias("out"),
        )

    folded = rows.select("doc_id", F.explode(F.aggregate("hs", start, step, lambda acc: acc["out"])).alias("o"))
    return headings.join(folded.select("doc_id", F.col("o.pos").alias("pos"), F.col("o.parent_pos").alias("parent_pos")), ["doc_id", "pos"])


def sibling_ordinals(tree: DataFrame) -> DataFrame:
    """Adds ``order_in_parent``, counted over all siblings, with text or not."""
    w = Window.partitionBy("doc_id", "parent_pos").orderBy("pos")
    return tree.withColumn("order_in_parent", F.row_number().over(w) - 1)


def paths(tree: DataFrame) -> DataFrame:
    """``(doc_id, pos, path, chunk_parent_pos)`` of the sections with text of ``(doc_id, slug, pos, title, text, parent_pos)``, a tree of :func:`heading_tree`.

    One fold over each document's headings with an array of those that are open,
    so that only labels travel, and no path but those returned is ever kept.
    """
    label = X.path_label(X.first_filled(X.clause_number(F.col("title")), F.col("title")))
    heading = F.struct(F.col("pos").cast("int").alias("pos"), F.col("parent_pos").cast("int").alias("parent_pos"), label.alias("label"), (F.length("text") > 0).alias("has_text"), X.path_label(F.col("slug")).alias("slug"))
    rows = tree.groupBy("doc_id").agg(F.sort_array(F.collect_list(heading)).alias("hs"))
    start = F.struct(
        F.array().cast("array<struct<pos:int,path:string,chunk:int>>").alias("open"), F.array().cast("array<struct<pos:int,path:string,chunk_parent_pos:int>>").alias("out")
    )

    def step(acc: Column, h: Column) -> Column:
        open_ = F.filter(acc["open"], lambda s: s["pos"] <= h["parent_pos"])  # the parent comes last
        above = F.get(open_, F.size(open_) - 1)
        path = X.path_join(above["path"], h["label"])
        here = F.struct(h["pos"].alias("pos"), path.alias("path"), F.when(h["has_text"], h["pos"]).otherwise(above["chunk"]).alias("chunk"))
        chunk = F.struct(h["pos"].alias("pos"), X.path_join(h["slug"], path).alias("path"), above["chunk"].alias("chunk_parent_pos"))
        return F.struct(F.array_append(open_, here).alias("open"), F.when(h["has_text"], F.array_append(acc["out"], chunk)).otherwise(acc["out"]).alias("out"))

    folded = rows.select("doc_id", F.explode(F.aggregate("hs", start, step, lambda acc: acc["out"])).alias("o"))
    return folded.select("doc_id", "o.pos", "o.path", "o.chunk_parent_pos")


def build_chunks(tree: DataFrame) -> DataFrame:
    """Chunks of a tree ``(doc_id, slug, pos, level, title, text, parent_pos)`` of :func:`heading_tree`.

    A section with text is a chunk.  Its path joins the labels of the headings
    above it; its parent is the nearest ancestor with text.
    """
    return sibling_ordinals(tree).join(paths(tree), ["doc_id", "pos"]).select(
        "doc_id", "pos", "level", X.clause_number(F.col("title")).alias("clause_number"), "title", "path", "chunk_parent_pos", "order_in_parent", "text",
    )


def latest_preceding_parent(chunks: DataFrame) -> DataFrame:
    """``parent_id`` of ``(doc_id, pos, path, parent_path)``: the last earlier row whose path is the parent path.

    Children and possible parents are merged by path in one window, so
    duplicate paths don't multiply rows.
    """
    as_parent = chunks.select("doc_id", F.col("path").alias("p"), "pos", F.lit(None).cast("int").alias("child"), F.col("pos").alias("parent"))
    as_child = chunks.where("parent_path is not null").select(
        "doc_id", F.col("parent_path").alias("p"), "pos", F.col("pos").alias("child"), F.lit(None).cast("int").alias("parent")
    )
    w = Window.partitionBy("doc_id", "p").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = as_parent.unionByName(as_child).withColumn("parent_id", F.last("parent", ignorenulls=True).over(w)).where("child is not null")
    return chunks.join(found.select("doc_id", F.col("child").alias("pos"), "parent_id"), ["doc_id", "pos"], "left")


def token_batches(texts: DataFrame, max_texts: int, max_tokens: int) -> DataFrame:
    """``(doc_id, pos, batch)`` from ``(doc_id, pos, tokens)``: batches for one call each, in order, by document.

    A batch is closed when it is full or the next text would exceed its tokens;
    a larger text is a batch of its own.
    """
    rows = texts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tokens"))).alias("ts"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("t"), F.array().cast("array<struct<pos:int,batch:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        close = (acc["n"] > 0) & ((acc["n"] >= max_texts) | (acc["t"] + x["tokens"] > max_tokens))
        b = F.when(close, acc["b"] + 1).otherwise(acc["b"])
        return F.struct(
            b.alias("b"),
            F.when(close, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            F.when(close, x["tokens"].cast("long")).otherwise(acc["t"] + x["tokens"]).alias("t"),
            F.array_append(acc["out"], F.struct(x["pos"].cast("int").alias("pos"), b.alias("batch"))).alias("out"),
        )

    return rows.select("doc_id", F.explode(F.aggregate("ts", start, step, lambda acc: acc["out"])).alias("o")).select("doc_id", "o.pos", "o.batch")


def page_blocks(pages: DataFrame) -> DataFrame:
    """``(doc_id, pos, level, text)`` of ``(page_id, html)``: headings with their level and paragraphs with level 0, in page order.

    Paragraphs may be left open and hold other elements; white space runs
    together, and what shows nothing or isn't the page's own text (``HIDDEN``)
    goes.  Null pages have no blocks.  All in compiled expressions, page by page.
    """
    html = F.col("html")
    for pattern, to in REWRITES:
        html = F.regexp_replace(html, pattern, to)
    blocks = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(html, BOUND)).alias("pos", "block"))
    heading = F.col("block").startswith(HEADING)
    text = F.when(heading, F.substring("block", 3, 2**31 - 1)).otherwise(F.col("block"))
    for name, letter in CHARACTERS:
        text = F.replace(text, F.lit(name), F.lit(letter))
    level = F.when(heading, F.substring("block", 2, 1).cast("int")).otherwise(0)
    return blocks.select("doc_id", "pos", level.alias("level"), F.trim(text).alias("text")).where(F.length("text") > 0)


def block_sections(blocks: DataFrame) -> DataFrame:
    """``(doc_id, pos, level, title, text)``: headings with the paragraphs up to the next one, joined by line ends.

    Paragraphs before a page's first heading belong to no section.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = blocks.withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w)).where("section > 0")
    body = F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "text"))))
    grouped = marked.groupBy("doc_id", "section").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.col("text"))).alias("title"), body.alias("body"))
    return grouped.select("doc_id", (F.col("section") - 1).cast("int").alias("pos"), "level", "title", F.array_join(F.transform("body", lambda b: b["text"]), "\n").alias("text"))


def page_sections(pages: DataFrame) -> DataFrame:
    """Title and body of pages with one heading: paragraphs joined by line ends."""
    paragraphs = F.regexp_extract_all("html", F.lit("<p>([^<]+)</p>"), F.lit(1))
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return pages.select("page_id", title.alias("title"), F.array_join(paragraphs, "\n").alias("text"), F.size(paragraphs).alias("n_paragraphs"))
