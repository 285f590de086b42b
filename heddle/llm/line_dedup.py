"""Fuzzy deduplication of lines across documents, in DataFrame operations only.

Lines are normalised (lower case, runs of letters, marks and digits as words); equal ones form a
class.  Each class gets a SimHash of 120 bits by sparse projections: a word's
hash deals it to one of five blocks, and there it votes on 24 bits.  A changed
word touches only its own block, so two lines whose changed words leave one
block untouched agree in it (pigeonhole): they meet in a bucket keyed by that
block, are candidates if their whole SimHashes differ in at most 14 bits and
their lengths allow it, and link if their edit similarity is at least 0.9.
Short lines have three blocks; long ones have a SimHash for each part of their
vocabulary.  One occurrence stays of each connected group of classes: the one in
the least document, and there the first.

Votes are counted in packed lanes, one for each block, so that one compiled
aggregation over exploded words makes all 24 sums.  Texts of lines never travel
but for those of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.operators.components import connected, extended
from heddle.session import free, materialize

from .common import table

LEAST_SIMILARITY = 0.9
#: Blocks of a SimHash, bits of each, and differing bits of two candidates' SimHashes.
BLOCKS, BITS, MOST_BITS = 5, 24, 14
#: Parts of the edits allowed that are tried first: one in so many.
FIRST_LIMITS = (64, 16, 4)
#: Lines of fewer words have so many blocks instead; longer ones one SimHash for each (power of two times) ``PART_WORDS`` words.
SHORT_WORDS, SHORT_BLOCKS, PART_WORDS = 16, 3, 96
#: Up to this excess over the least number of words of its level, a line is also entered on the level below.
OVERLAP = 1.2
#: Bits of a lane, and words that are counted together: no more than a lane can hold.
LANE, PIECE_WORDS = 12, 4095
#: Buckets of more classes are split further, by length, and what is still larger goes through hubs first.
LARGE = 64
#: Rounds of hubs before what is still apart in a large bucket is compared with all of it.
HUB_ROUNDS = 2
#: Ratio of the length bands that split large buckets: lines that may link are in the same or the next one.
BAND = 1 / LEAST_SIMILARITY + 0.001
#: Classes of a bucket that one task compares with the others.
APART = 2_048

_UNITS = sum(1 << (LANE * i) for i in range(BLOCKS))
_HALF = (1 << (LANE - 1)) - 1
_HALF_BITS = BITS // 2


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _now(value: Column) -> Column:
    """``value``, evaluated where it stands.

    Compiled code puts off what an explode only passes on until after it, and
    would evaluate it again for each word; what isn't deterministic it doesn't.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def line_words(line: Column) -> Column:
    """Words of a normalised line."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{M}\p{N}]+"), "")


def normal(line: Column) -> Column:
    return F.array_join(line_words(line), " ")


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, text)`` of documents with an id and a text."""
    rows = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull())
    return rows.select(docs["doc_id"].alias("doc_id"), _now(F.xxhash64(docs["doc_id"], docs["text"])).alias("row_key"), docs["text"].alias("text"))


def raw_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, pos, line)`` for each line of documents with an id and a text."""
    return _keyed(docs).select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _levels(n: Column) -> Column:
    """Numbers of blocks under which a line of ``n`` words is entered: one, or two near the bound of a level."""
    # bounds of the levels, in words, and numbers of blocks above each
    bounds, blocks = [SHORT_WORDS], [BLOCKS]
    while 2 * blocks[-1] * PART_WORDS <= BLOCKS * PIECE_WORDS:
        blocks.append(2 * blocks[-1])
        bounds.append(blocks[-1] * PART_WORDS // BLOCKS)
    out = F.array(F.lit(SHORT_BLOCKS))
    for i, (least, own) in enumerate(zip(bounds, blocks, strict=True)):
        below = blocks[i - 1] if i else SHORT_BLOCKS
        out = F.when(n >= OVERLAP * least, F.array(F.lit(own))).when(n >= least, F.array(F.lit(own), F.lit(below))).otherwise(out)
    return out


LINE = ["doc_id", "row_key", "pos", "d1", "d2", "len"]


def line_sims(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, pos, d1, d2, len, part, counts, w0, w1)`` for each part of each line with a letter.

    ``d1`` and ``d2`` are 128 bits that stand for the normalised line.  ``w0``
    and ``w1`` have 12 bits of each block, and ``counts`` its number of words.
    """
    lines = raw_lines(docs).select("doc_id", "row_key", "pos", _now(line_words(F.col("line"))).alias("words"))
    # lines without a word give no rows below; a filter here would split all texts twice
    lines = lines.select(
        # a number for each line row, so that repeated rows aren't counted together
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "row_key",
        "pos",
        _now(F.xxhash64("words")).alias("d1"),
        _now(F.xxhash64(F.lit(1), "words")).alias("d2"),
        _now(F.length(F.array_join("words", " "))).alias("len"),
        F.least(F.size("words"), F.lit(PIECE_WORDS)).alias("n"),
        "words",
    )
    leveled = lines.select("row", *LINE, "words", F.explode(_levels(F.col("n"))).alias("blocks"))
    words = leveled.select("row", *LINE, "blocks", F.posexplode("words").alias("i", "word"))
    hashed = words.select("row", *LINE, "blocks", F.floor(F.col("i") / PIECE_WORDS).cast("int").alias("piece"), F.xxhash64("word").alias("h"))
    hashed = hashed.withColumn("block", F.pmod(F.shiftrightunsigned("h", 32), F.col("blocks")).cast("int"))
    part = F.shiftleft(F.col("piece").cast("long"), 40).bitwiseOR(F.shiftleft(F.col("blocks").cast("long"), 20)).bitwiseOR(F.floor(F.col("block") / BLOCKS))
    hashed = hashed.select("row", *LINE, "h", part.alias("part"), F.expr(f"shiftleft(1L, {LANE} * (block % {BLOCKS}))").alias("unit"))

    def votes(k: int) -> Column:  # the unit of the word's lane, if bit k of its hash is set
        return F.shiftright(F.shiftleft("h", 63 - k), 63).bitwiseAND(F.col("unit"))

    summed = hashed.groupBy("row", "part").agg(
        *(F.max(c).alias(c) for c in LINE), F.sum("unit").alias("counts"), *(F.sum(votes(k)).alias(f"s{k}") for k in range(BITS))
    )
    return summed.select(*LINE, "part", "counts", _majorities(0).alias("w0"), _majorities(_HALF_BITS).alias("w1"))


def _majorities(first: int) -> Column:
    """12 bits of each block, in its lane: those that more than half of the block's words have set."""
    half = F.shiftright("counts", 1).bitwiseAND(_long(_UNITS * _HALF))
    out = None
    for k in range(first, first + _HALF_BITS):
        # a lane exceeds 2047 if its sum exceeds half of its count; no lane overflows into the next
        over = F.shiftright(F.col(f"s{k}") + (_long(_UNITS * _HALF) - half), LANE - 1).bitwiseAND(_long(_UNITS))
        over = F.shiftleft(over, k - first)
        out = over if out is None else out.bitwiseOR(over)
    return out


def _edits(length: Column) -> Column:
    """Edits that a line of this length, the longer of two, may be away."""
    return F.floor((1 - LEAST_SIMILARITY) * length + 1e-9).cast("int")


def _near(x: str, y: str) -> Column:
    longer, shorter = F.greatest(f"{x}.len", f"{y}.len"), F.least(f"{x}.len", f"{y}.len")
    return (F.col(f"{x}.node") != F.col(f"{y}.node")) & (longer - shorter <= _edits(longer)) & (_distance(x, y) <= MOST_BITS)


def _distance(x: str, y: str) -> Column:
    """Bits in which the SimHashes differ."""
    return F.bit_count(F.col(f"{x}.w0").bitwiseXOR(F.col(f"{y}.w0"))) + F.bit_count(F.col(f"{x}.w1").bitwiseXOR(F.col(f"{y}.w1")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), _distance("x", "y").alias("bits"))


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.min("bits").alias("bits"))


def _lanes(block: str, *columns: str) -> list[Column]:
    """The block's lane of each of the columns."""
    return [F.expr(f"shiftright({c}, {LANE} * ({block}))").bitwiseAND(_long((1 << LANE) - 1)) for c in columns]


def _members(sims: DataFrame) -> DataFrame:
    """``(key, block, node, len, part, counts, w0, w1)`` for each block with words of each class's parts."""
    blocks = sims.select("node", "len", "part", "counts", "w0", "w1", F.explode(F.lit(list(range(BLOCKS)))).alias("block"))
    own = _lanes("block", "counts", "w0", "w1")
    return blocks.where(own[0] > 0).select(F.xxhash64("part", "block", *own).alias("key"), "block", "node", "len", "part", "counts", "w0", "w1")


#: What a member of a bucket has.
MEMBER = ["key", "node", "len", "w0", "w1"]


def _sized(members: DataFrame) -> DataFrame:
    """``members`` of buckets of several classes, with the bucket's size ``n`` and two classes of it as hubs."""
    own = Window.partitionBy("key")
    sized = members.select("*", F.count("*").over(own).alias("n"), F.min("node").over(own).alias("lo"), F.max("node").over(own).alias("hi"))
    return sized.where("lo <> hi")


def candidate_pairs(sims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b, bits)`` of classes that share a block and are near, and the members of buckets too large to be expanded.

    A large bucket's block is one of frequent words.  It is split by bands of
    length, two for each member, so that no pair of near lengths is parted.
    What is large even then has hubs here: each member's pair with the bucket's
    first class and with its last one; :func:`components` compares the rest of it,
    so that a pair needs one shared block only, however large its bucket.
    """
    buckets = materialize(_sized(_members(sims).select(MEMBER)), "line-buckets")
    band = F.floor(F.log(F.col("len").cast("double")) / F.log(F.lit(BAND))).cast("int")
    banded = buckets.where(F.col("n") > LARGE).select("*", F.explode(F.array(band, band + 1)).alias("band"))
    banded = materialize(_sized(banded.select(F.xxhash64("key", "band").alias("key"), *MEMBER[1:])), "line-bands")
    small = buckets.where(F.col("n") <= LARGE).select(MEMBER).union(banded.where(F.col("n") <= LARGE).select(MEMBER))
    large = materialize(banded.where(F.col("n") > LARGE), "line-large")
    pairs = _ordered(small.alias("x").join(small.alias("y"), "key").where("x.node < y.node").where(_near("x", "y")))
    for end in ("lo", "hi"):
        hubs = large.where(F.col("node") == F.col(end)).select(MEMBER).distinct()
        pairs = pairs.union(_ordered(large.alias("x").join(hubs.alias("y"), "key").where(_near("x", "y"))))
    pairs = materialize(_once(pairs), "line-pairs")
    free(buckets, banded)
    return pairs, large


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, norm)`` of the given classes, as a written table.

    Documents meet their wanted lines as a whole and are cut only then, so that other lines are no rows.
    """
    wanted = classes.join(nodes.select("node").distinct(), "node").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("pos", "node")).alias("places"))
    wanted = materialize(wanted, "line-wanted")
    # of repeated rows one is enough; they are together already, so that texts of lines needn't be dealt out again
    found = _keyed(docs).join(wanted, ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"]).select("places", _now(F.split("text", "\n")).alias("lines"))
    found = found.select(F.explode(F.transform("places", lambda p: F.struct(p["node"].alias("node"), F.get("lines", p["pos"]).alias("line")))).alias("at"))
    texts = materialize(found.select("at.node", normal(F.col("at.line")).alias("norm")), "line-texts")
    free(wanted)
    return texts


def _cores(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``na`` and ``nb`` bare of the words they begin and end with alike, and ``above``, which their distance doesn't exceed.

    Each word counts with the blank after it, so the distance stays what it is.
    """
    words = pairs.select("a", "b", "most", _now(F.split("na", " ")).alias("wa"), _now(F.split("nb", " ")).alias("wb"))
    for _ in range(2):  # from the front, then, the words reversed, from the end; the second time puts them in order again
        first = _now(F.expr("array_position(zip_with(wa, wb, (x, y) -> x <=> y), false)"))
        words = words.withColumn("at", first).select(
            "a", "b", "most", *(_now(F.expr(f"reverse(slice({w}, int(at), greatest(size({w}) - int(at) + 1, 0)))")).alias(w) for w in ("wa", "wb"))
        )
    cost = "CASE WHEN x <=> y THEN 0 WHEN x IS NULL THEN length(y) + 1 WHEN y IS NULL THEN length(x) + 1 ELSE greatest(length(x), length(y)) END"
    above = F.expr(f"aggregate(zip_with(wa, wb, (x, y) -> {cost}), 0, (s, x) -> s + x)")
    return words.select("a", "b", "most", _now(above).alias("above"), *(F.array_join(F.transform(w, lambda x: F.concat(x, F.lit(" "))), "").alias(n) for w, n in (("wa", "na"), ("wb", "nb"))))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of classes whose lines have the edit similarity, as a written table."""
    both = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("norm").alias("na")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("norm").alias("nb")), "b")
        .withColumn("most", _edits(F.greatest(F.length("na"), F.length("nb"))))
    )
    # within the limit the distance is exact, beyond it -1, and time grows with the limit: lower ones are tried first
    tries = " ".join(f"WHEN most >= {n} AND levenshtein(na, nb, most div {n}) >= 0 THEN true" for n in FIRST_LIMITS)
    linked = F.expr(f"CASE WHEN above <= most THEN true {tries} ELSE levenshtein(na, nb, most) >= 0 END")
    return materialize(_cores(both).where(linked).select("a", "b"), "line-links")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def components(docs: DataFrame, classes: DataFrame, sims: DataFrame) -> DataFrame:
    """``(node, component)`` for the classes with a link."""
    pairs, large = candidate_pairs(sims)
    free(sims)
    texts = _texts(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")))
    # the nearest pair of each class first; then only what is still apart, or near copies would be compared over and over
    links = _verified(pairs.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("best")).select("best.a", "b", "best.bits"), texts)
    labels = materialize(connected(links), "labels")
    apart = pairs.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    apart = apart.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    rest = _verified(apart.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "bits"), texts)
    labels = extended(labels, rest)
    free(pairs, links, rest)
    labels = _linked_in_large(large.select(MEMBER), labels, texts)
    free(large, texts)
    return labels


def _linked_in_large(large: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """``labels`` after all links within the large buckets.

    First each bucket's members are compared with one class outside its main
    component, twice; that joins families of near lines.  Then every class that
    is still apart from the main component is compared with all classes of
    other components, so that no link is lost.  Of a bucket, a task gets about
    ``APART`` of those.
    """
    for k in range(HUB_ROUNDS + 1):
        now = _labelled(large, labels)
        sizes = now.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("node").alias("hub"))
        main = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n")).where("labels > 1")
        main = main.select("key", F.col("main.label").alias("main"), F.expr(f"1 + n div {APART}").cast("int").alias("shares"))
        main = materialize(main, "line-mains")
        if main.isEmpty():
            free(main)
            return labels
        if k < HUB_ROUNDS:
            hubs = sizes.join(main, "key").where("label <> main").groupBy("key").agg(F.max(F.struct("n", "hub")).alias("h"))
            hubs = now.join(hubs, "key").where("node = h.hub").select(*MEMBER, "label").distinct()
            new = now.alias("x").join(hubs.alias("y"), "key").where("x.label <> y.label")
        else:
            shared = now.join(main, "key")
            apart = shared.where("label <> main").withColumn("share", F.expr("pmod(xxhash64(node), shares)").cast("int"))
            every = shared.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            # of two that are both apart, one order is enough
            new = apart.alias("x").join(every.alias("y"), ["key", "share"]).where("x.label < y.label or x.label > y.label and y.label = x.main")
        new = _verified(_once(_ordered(new.where(_near("x", "y")))), texts)
        if not new.isEmpty():
            labels = extended(labels, new)
        free(main, new)
    return labels


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`line_sims`, and ``(d1, d2, component, doc_id, pos)`` of the classes that occur twice or have a link.

    ``doc_id`` and ``pos`` are a class's first occurrence.  Both are written tables.
    """
    rows = materialize(line_sims(docs), "line-sims")
    # the number of a class is fixed by being written; of equal lines the first occurrence stands for all
    place = F.struct("doc_id", "pos", "row_key")
    classes = rows.groupBy("d1", "d2").agg(F.min(place).alias("at"), F.max(place).alias("last"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "at.*", (F.col("at") != F.col("last")).alias("several"))
    classes = materialize(classes, "line-classes")
    sims = rows.join(classes.select("node", "doc_id", "row_key", "pos"), ["doc_id", "row_key", "pos"])
    sims = materialize(sims.select("node", "len", "part", "counts", "w0", "w1"), "line-signatures")
    labels = components(docs, classes, sims)
    linked = classes.join(labels, "node", "left")
    # classes that occur once and have no link lose nothing
    several = linked.where("several or component is not null").withColumn("component", F.coalesce("component", "node"))
    several = materialize(several.select("d1", "d2", "component", "doc_id", "pos"), "line-groups")
    free(classes, labels)
    return rows, several


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, drops)``: positions of the lines that go, for documents that lose some."""
    rows, several = line_groups(docs)
    keepers = several.groupBy("component").agg(F.min(F.struct("doc_id", "pos")).alias("keep"))
    verdict = several.join(keepers, "component").select("d1", "d2", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.pos").alias("keep_pos"))
    gone = rows.select("doc_id", "row_key", "pos", "d1", "d2").join(verdict, ["d1", "d2"])
    gone = gone.where((F.col("doc_id") != F.col("keep_doc")) | (F.col("pos") != F.col("keep_pos")))
    drops = materialize(gone.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("drops")), "line-drops")
    free(rows, several)
    return drops


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with one occurrence of each group of near-equal lines left in ``text``.

    All columns are kept, ``text`` changed, ``n_lines`` and ``n_dropped`` added
    (they replace columns of that name); other columns may have any names.
    Lines end with ``\\n``; lines without a letter, blank ones too, always stay.
    Null text stays null, with no lines; a text that loses all its lines becomes
    empty.  Very long lines are looked at whole, in pieces of 4,095 words for
    their SimHashes.  Documents with a null id neither lose lines nor count as
    an occurrence.  Repeated rows are one document: what the first keeps, all
    keep.  Ties are broken by document and place.  An empty table gives none.
    """
    drops = dropped_lines(docs)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(
        F.struct(*(docs[c] for c in own)).alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key")
    )
    joined = keyed.join(drops, ["doc_id", "row_key"], "left")
    # split once, not again for each line that stays
    joined = joined.select("row", "drops", _now(F.split("row.text", "\n")).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    text = F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in own),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
