"""Exact copies, near lines and near documents, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
from compare import oracle, same
from pyspark.sql import functions as F

from heddle import session
from heddle.llm import catalog, exact_dedup, jaccard_join, line_dedup
from heddle.session import shared_dir

DUCK = duckdb.connect()


def test_exact_same_as_sql(spark, small):
    same(exact_dedup.query(spark, small), oracle(small), catalog.SQL["op8_exact_dedup"])


def test_exact_on_odd_rows(odd, empty, texts):
    got = sorted((r["doc_id"] is None, r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(odd).collect())
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = []
    for i, t in texts:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i is None, i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert exact_dedup.exact_dedup(odd).count() == sum(w[4] for w in want)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_when_an_id_has_several_texts(spark):
    rows = [(1, "x"), (7, "x"), (7, "y"), (9, "y"), (None, "z"), (None, "y")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, digest string")
    assert sorted((str(r["doc_id"]), r["text"], r["digest"]) for r in exact_dedup.exact_dedup(docs).collect()) == [("7", "x", "k"), ("9", "y", "k"), ("None", "z", "k")]


def test_exact_with_one_salt_and_many(odd):
    one, many = (sorted(map(str, exact_dedup.exact_groups(odd, s).collect())) for s in (1, 7))
    assert one == many


def union_find(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent, find = union_find(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    known = lambda ids: min([i for i in ids if i is not None], default=None)
    return Counter((i, len(sets[k]), i if not sets[k] else known(least[find(k)])) for k, (i, _) in enumerate(rows))


def test_jaccard_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in jaccard_join.query(spark, small).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_brute(rows)


def test_jaccard_on_odd_rows(odd, empty, texts):
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(odd).collect())
    assert got == jaccard_brute(texts)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_of_a_large_family(spark):
    """Near copies that link in chains only, more than a bucket's hub can reach at once."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in range(i % 7):
            words[(i * 13 + j * 17) % 60] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == jaccard_brute(rows)


def test_prefixes_meet_under_every_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        universe = rng.choice(10_000, 200, replace=False).astype(np.uint64)
        often = dict(zip(universe.tolist(), rng.integers(2, 9, 200).tolist()))
        a = np.sort(universe[:100])
        b = np.sort(np.r_[universe[rng.integers(0, 15) : 100], universe[100 : 100 + rng.integers(0, 10)]])
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common):
            continue
        for order in (1, 2, 3):
            p = [jaccard_join._prefix(x, np.array([often[i] for i in x.tolist()]), len(x), 75, order) for x in (a, b)]
            assert len(np.intersect1d(*p))


def test_packing_of_postings():
    hashes = np.sort(np.random.default_rng(2).integers(0, 2**56, 1000).astype(np.uint64))
    classes, index = np.array([-5, 7], dtype=np.int64), np.arange(1000) % 2
    sizes = np.array([2000, 2**31])
    back, who, size = jaccard_join._unpack(jaccard_join._pack(hashes, index, classes, sizes))
    assert (back == hashes).all() and (who == classes[index]).all() and (size == sizes[index]).all()


def test_packing_of_groups():
    classes, sizes, counts = np.array([-5, 7], dtype=np.int64), np.array([9, 8]), np.array([2, 3])
    for top in (10, 2**40):
        token, often = np.array([1, top, 2, 3, top], dtype=np.uint64), np.array([2, 3, 4, 5, 255], dtype=np.uint8)
        who, size, back, freq = jaccard_join._unpack_group(jaccard_join._pack_group(classes, sizes, counts, token, often))
        assert who.tolist() == [-5, -5, 7, 7, 7] and size.tolist() == [9, 9, 8, 8, 8]
        assert (back == token).all() and (freq == often).all()


def normal(line):
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line.lower()).strip()


def levenshtein(a, b):
    for _ in range(2):  # what both begin and end with costs nothing
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[k:][::-1], b[k:][::-1]
    return DUCK.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0]


def own_sims(words):
    """By part: 24 bits and the number of words of each block, counted word by word."""
    xxhash = pytest.importorskip("xxhash")
    n, out = min(len(words), 4095), {}
    levels = [(16, 5)] + [(96 * 2**i, 5 * 2**i) for i in range(1, 6)]
    sizes = [3]
    for least, blocks in levels:
        if n >= least:
            sizes = [blocks] + ([sizes[0]] if n < 1.2 * least else [])
    for i, w in enumerate(words):
        h = xxhash.xxh64(w.encode(), seed=42).intdigest()
        for size in sizes:
            block = (h >> 32) % size
            own = out.setdefault((i // 4095, size, block // 5), defaultdict(Counter))[block % 5]
            own["n"] += 1
            own.update(k for k in range(24) if h >> k & 1)
    return {p: {b: (c["n"], sum(1 << k for k in range(24) if c[k] > c["n"] // 2)) for b, c in blocks.items()} for p, blocks in out.items()}


def are_candidates(x, y):
    for part in x.keys() & y.keys():
        a, b = x[part], y[part]
        bits = sum((a.get(k, (0, 0))[1] ^ b.get(k, (0, 0))[1]).bit_count() for k in range(5))
        if bits <= 14 and any(a[k] == b[k] for k in a.keys() & b.keys()):
            return True
    return False


def lines_brute(docs):
    """Lines that stay, by document, all pairs of lines compared."""
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["text"] is not None})
    lines = [(i, pos, normal(line)) for i, t in rows for pos, line in enumerate(t.split("\n"))]
    distinct = sorted({n for _, _, n in lines if n})
    sims = [own_sims(n.split(" ")) for n in distinct]
    parent, find = union_find(len(distinct))
    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            most = int(0.1 * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and are_candidates(sims[i], sims[j]) and levenshtein(a, b) <= most:
                parent[find(i)] = find(j)
    group = {n: find(i) for i, n in enumerate(distinct)}
    seen, out = set(), defaultdict(list)
    for i, pos, n in lines:
        if not n or group[n] not in seen:
            out[i].append(pos)
            seen.add(group[n] if n else None)
    return out


@pytest.mark.parametrize("source", ["small", "odd"])
def test_lines_equal_brute_force(spark, source, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 40") if source == "small" else odd
    want = lines_brute(docs)
    for r in line_dedup.dedup_lines(docs).collect():
        before = next(x["text"] for x in docs.where(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]))).collect())
        if r["doc_id"] is None or before is None:
            assert r["text"] == before and r["n_dropped"] == 0
            continue
        lines = before.split("\n")
        assert r["text"] == "\n".join(lines[p] for p in want[r["doc_id"]])
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(want[r["doc_id"]]))


def test_lines_of_a_large_bucket(spark):
    """A family of more near lines than a bucket expands."""
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(90):
        own = list(words)
        own[i] = own[i] + "x"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = lines_brute(docs)
    got = {r["doc_id"]: r["n_lines"] - r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: len(want[i]) for i in range(90)}


def test_lines_that_differ_in_digits_or_marks_are_different(spark):
    texts = ["Invoice 2021 total 5531 euro", "Invoice 1999 total 12 euro", "कि मी", "की मु", "invoice 2021, total 5531 EURO"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_lines"] - r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_lines_of_no_rows(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def test_simhash_of_long_and_short_lines(spark):
    texts = ["a b c d", "one two three four five", " ".join(f"w{chr(97 + i % 26)}" for i in range(9_000)), " ".join("abc" for _ in range(600)), " ".join(f"v{chr(97 + i)}" for i in range(18))]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = defaultdict(dict)
    for r in line_dedup.line_sims(docs).collect():
        part = (r["part"] >> 40, r["part"] >> 20 & 0xFFFFF, r["part"] & 0xFFFFF)
        lane = lambda x, b: x >> 12 * b & 0xFFF
        got[r["doc_id"]][part] = {b: (lane(r["counts"], b), lane(r["w0"], b) | lane(r["w1"], b) << 12) for b in range(5) if lane(r["counts"], b)}
    for i, t in enumerate(texts):
        assert got[i] == own_sims(t.split(" "))


def test_digests_are_two(spark):
    rows = line_dedup.line_sims(spark.createDataFrame([(i, f"line {chr(97 + i)}") for i in range(20)], "doc_id long, text string")).collect()
    assert len({r["d1"] for r in rows}) == len({r["d2"] for r in rows}) == 20
    one = spark.createDataFrame([(r["d1"],) for r in rows], "d long").select(F.xxhash64(F.lit(1), "d")).collect()
    assert not {r[0] for r in one} & {r["d2"] for r in rows}


def test_lines_recall_against_edit_similarity(spark, small):
    """Of all pairs of lines with the edit similarity, at least nine of ten are in one group."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    own = sorted({normal(x) for r in docs.collect() if r["text"] for x in r["text"].split("\n")} - {""})
    own = [x for x in own if len(x) <= 500]
    db = DUCK
    db.execute("CREATE TABLE l (i INT, t VARCHAR)")
    db.executemany("INSERT INTO l VALUES (?, ?)", list(enumerate(own)))
    near = "abs(length(a.t) - length(b.t)) <= most AND levenshtein(a.t, b.t) <= most"
    pairs = db.execute(f"SELECT a.i, b.i FROM l a, l b, LATERAL (SELECT floor(0.1 * greatest(length(a.t), length(b.t)) + 1e-9) AS most) WHERE a.i < b.i AND {near}").fetchall()
    keys = spark.createDataFrame(list(enumerate(own)), "i int, t string").withColumn("w", F.split("t", " "))
    keys = keys.select("i", F.xxhash64("w").alias("d1"), F.xxhash64(F.lit(1), "w").alias("d2"))
    group = {r["i"]: r["component"] for r in keys.join(line_dedup.line_groups(docs)[1], ["d1", "d2"]).collect()}
    found = sum(a in group and group[a] == group.get(b) for a, b in pairs)
    assert len(pairs) > 10 and found >= 0.9 * len(pairs)


@pytest.mark.parametrize("n", [10, 120])
def test_pairs_of_lines_in_one_large_bucket(spark, n):
    """Lines that share 30 words and differ in a long one: each is one edit from its twin and far from all others."""
    rng = np.random.default_rng(3)
    fixed = " ".join("".join(map(chr, rng.integers(97, 123, 4))) for _ in range(30))
    rows = []
    for i in range(n):
        long = "".join(map(chr, rng.integers(97, 123, 60)))
        rows += [(2 * i, f"{fixed} {long}a"), (2 * i + 1, f"{fixed} {long}b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = lines_brute(docs)
    got = {r["doc_id"]: r["n_lines"] - r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: len(want[i]) for i in range(2 * n)} and sum(got.values()) == n


def test_twins_that_share_one_block_only_in_a_large_bucket(spark):
    """All lines have one block alike; twins, within the bits allowed, have no other one in common, and are far from all others."""
    rng = np.random.default_rng(5)
    words = sorted({"".join(map(chr, rng.integers(97, 123, 6))) for _ in range(12_000)})
    by_block = defaultdict(list)
    for w in words:
        by_block[next(iter(own_sims([w] * 16)[0, 5, 0]))].append(w)
    fixed, rows = by_block[0][:12], []
    while len(rows) < 80:
        own = [[by_block[k].pop() for _ in range(15)] for k in range(1, 5)]
        twin = [[by_block[k][0], *ws[1:]] for k, ws in enumerate(own, 1)]
        x, y = ([*fixed, *(w for ws in o for w in ws)] for o in (own, twin))
        a, b = own_sims(x)[0, 5, 0], own_sims(y)[0, 5, 0]
        if sum(a[k] == b[k] for k in range(5)) == 1 and sum((a[k][1] ^ b[k][1]).bit_count() for k in range(5)) <= 14:
            rows += [(len(rows), " ".join(x)), (len(rows) + 1, " ".join(y))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = lines_brute(docs)
    got = {r["doc_id"]: r["n_lines"] - r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: len(want[i]) for i in range(80)} and sum(got.values()) == 40


def test_lines_free_their_tables(spark):
    """Of the line tables only the positions that go are left for the result, which reads them."""
    folder = Path(shared_dir(spark).removeprefix("file://")) / "heddle"
    before = set(folder.glob("line-*"))
    docs = spark.createDataFrame([(1, "one line of some words\nanother"), (2, "one line of some words")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: "one line of some words\nanother", 2: ""}
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.glob("line-*")) - before] == ["line-drops"]


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffle files go with the query that wrote the table, and the session's own setting stays."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        files = manager.getAllFiles()
        return {name for i in range(files.size()) if "shuffle" in (name := files.apply(i).getName())}

    before, setting = kept(), spark.conf.get(session.FREE_SHUFFLES, None)
    made = session.materialize(spark.range(10_000).groupBy((F.col("id") % 5_000).alias("k")).count(), "shuffled")
    assert not kept() - before and spark.conf.get(session.FREE_SHUFFLES, None) == setting
    assert made.count() == 5_000
    session.free(made)


def test_texts_of_repeated_rows_come_once(spark, monkeypatch):
    """A class's text is one row, and isn't dealt out by class for that."""
    written = {}
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: written.setdefault(label, df) if label == "line-texts" else session.materialize(df, label))
    monkeypatch.setattr(line_dedup, "free", lambda *tables: None)
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "g h")], "doc_id long, text string")
    keyed = line_dedup._keyed(docs).distinct()
    classes = keyed.select("doc_id", "row_key", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).where("doc_id = 1 or pos = 0")
    classes = classes.withColumn("node", F.col("doc_id") * 10 + F.col("pos"))
    got = line_dedup._texts(docs, classes, classes)
    assert sorted(map(tuple, got.collect())) == [(10, "a b c"), (11, "d e f"), (20, "g h")]
    assert "hashpartitioning(node" not in got._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
