"""Operators on small hand-made inputs: the invariants that their contracts state."""

import random

import pytest
from pyspark.sql import functions as F

from heddle import adapters
from heddle.functions import text as X
from heddle.functions.stemmer import porter
from heddle.operators import community, extraction, graph, ingest, search, sections
from heddle.operators.components import connected


def ranking(spark, *ids):
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, rank int")


def fused(spark, *rankings):
    out = search.reciprocal_rank_fusion([ranking(spark, *r) for r in rankings])
    return [r["id"] for r in out.orderBy("rank").collect()]


def test_fusion_keeps_one_ranking_and_prefers_overlap(spark):
    assert fused(spark, ["a", "b", "c"]) == ["a", "b", "c"]
    assert fused(spark, ["x", "sh"], ["y", "sh"]) == ["sh", "x", "y"]
    assert sorted(fused(spark, ["a"], ["b"])) == ["a", "b"]
    assert search.reciprocal_rank_fusion([ranking(spark, "a").where("false")]).count() == 0


def test_names_are_normalised(spark):
    cases = {"  personal   data.": "personal data", "PERSONAL-DATA!": "personaldata", "Données": "donnes", "a b": "a b", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", X.normalize_name(F.col("n")).alias("k"))
    assert {r["n"]: r["k"] for r in df.collect()} == cases


def test_facts_quote_names(spark):
    df = spark.createDataFrame([("it's", "plain")], "a string, b string")
    line = df.select(X.fact(F.lit("A.8"), F.lit("Risk"), F.col("a"), F.lit("REQUIRES"), F.lit("Control"), F.col("b"))).first()[0]
    assert line == "[A.8] Risk:\"it's\" --REQUIRES--> Control:'plain'"


def test_cosine_of_unequal_or_zero_vectors_is_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.05]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 0.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    got = [round(r[0], 6) for r in df.select(X.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.998752, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("probate", "probat"), ("sky", "sky"), ("controlling", "control")])
def test_stemmer(word, stem):
    assert porter(word) == stem


def test_heading_tree_equals_a_stack(spark):
    rng, heads, want = random.Random(3), [], []
    for doc in range(6):
        stack = []
        for pos in range(rng.randrange(1, 25)):
            level = rng.randrange(1, 5)
            while stack and stack[-1][1] >= level:
                stack.pop()
            want.append((doc, pos, stack[-1][0] if stack else None))
            stack.append((pos, level))
            heads.append((doc, pos, level))
    got = sections.heading_tree(spark.createDataFrame(heads, "doc_id long, pos int, level int")).select("doc_id", "pos", "parent_pos")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def batches(spark, tokens):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(tokens)], "doc_id long, pos int, tokens int")
    out = {}
    for r in sections.token_batches(df, 128, 4000).collect():
        out[r["batch"]] = out.get(r["batch"], 0) + 1
    return [out[b] for b in sorted(out)]


def test_token_batches(spark):
    assert batches(spark, [1000] * 10) == [4, 4, 2]
    assert batches(spark, [1] * 200) == [128, 72]
    assert batches(spark, [1, 9000, 1]) == [1, 1, 1]
    assert adapters.call_bounds([1] * 200, 128, 4000) == [0, 128, 200]
    assert adapters.call_bounds([3, 4, 5, 1, 1, 9, 2], 3, 8) == [0, 2, 5, 6, 7]
    assert adapters.call_bounds([], 3, 8) == [0]


def test_chunk_needs_text_and_finds_persisted_ancestor(spark):
    rows = [(0, 0, 1, "Part", "", "doc"), (0, 1, 2, "A.8 x", "t", "doc"), (0, 2, 3, "Empty", "", "doc"), (0, 3, 4, "Deep", "u", "doc"), (0, 4, 2, "!!", "v", "doc")]
    tree = sections.heading_tree(spark.createDataFrame(rows, "doc_id long, pos int, level int, title string, text string, slug string"))
    got = {r["pos"]: (r["path"], r["chunk_parent_pos"], r["order_in_parent"]) for r in sections.build_chunks(tree).collect()}
    assert got == {1: ("doc.part.a_8", None, 0), 3: ("doc.part.a_8.empty.deep", 1, 0), 4: ("doc.part.section", None, 1)}


def covers(words, terms):
    best = {}
    for e in range(len(words)):
        last = [max((i for i in range(e + 1) if words[i] == t), default=None) for t in terms]
        if None not in last and words[e] in terms:
            best[min(last)] = min(best.get(min(last), e), e)
    return sum(1 / (1 + e - b - (len(terms) - 1)) for b, e in best.items())


def test_lexical_score_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcde", k=rng.randrange(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for terms in (["a"], ["a", "b"], ["a", "b", "c"]):
        got = {r["id"]: r["score"] for r in search.lexical_scores(df, terms).collect()}
        want = {i: round(covers(t.split(), terms), 6) for i, t in enumerate(texts) if set(terms) <= set(t.split())}
        assert got == pytest.approx(want)
    assert search.lexical_scores(df, []).count() == 0


def edge_table(spark, edges):
    rows = [(f"e{i}", "Risk", a, "REQUIRES", "Risk", b, i, "d") for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame(rows, "edge_id string, source_type string, source_name string, relation_type string, target_type string, target_name string, chunk_id long, document_id string")


def test_expansion_is_breadth_first_and_stops(spark):
    edges = edge_table(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "y")])
    seed = spark.createDataFrame([("Risk", "a")], "entity_type string, name string")
    calls = []

    def fetch(e, keys):
        calls.append(keys.count())
        return graph.relations_touching(e, keys)

    got = {(r["source_name"], r["target_name"]): r["hop"] for r in graph.expand_hops(edges, seed, 3, fetch).collect()}
    assert got == {("a", "b"): 1, ("c", "b"): 2, ("c", "d"): 3}
    assert calls == [1, 1, 1]
    assert graph.expand_hops(edges, seed.where("false")).count() == 0
    alone = spark.createDataFrame([("Risk", "x")], "entity_type string, name string")
    assert {r["hop"] for r in graph.expand_hops(edges, alone, 9).collect()} == {1}


def test_weights_count_mentions_both_ways(spark):
    edges = edge_table(spark, [("a", "b"), ("b", "a"), ("a", "b"), ("a", "a")])
    assert [tuple(r) for r in graph.edge_weights(edges).collect()] == [("Risk", "a", "Risk", "b", 3)]


def test_upsert_keeps_first_embedding(spark):
    old = spark.createDataFrame([("Risk", "a", 1)], "entity_type string, name string, embedding int")
    new = spark.createDataFrame([("Risk", "a", 2, 0), ("Risk", "b", 4, 2), ("Risk", "b", 3, 1), ("Role", "a", 9, 3)], "entity_type string, name string, embedding int, pos int")
    assert sorted(map(tuple, graph.upsert_entities(old, new).collect())) == [("Risk", "a", 1), ("Risk", "b", 3), ("Role", "a", 9)]


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_communities_separate_and_connect(spark):
    cliques = [(f"{g}{i}", f"{g}{j}", 1) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1)]
    w = spark.createDataFrame(cliques, "a string, b string, weight int")
    vertices = spark.createDataFrame([("lone",)], "node string")
    got = {}
    for r in community.detect_communities(w, vertices).collect():
        got.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [[f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)], ["lone"]]


def candidates(spark, rows):
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "pos long, name string, entity_type string")


def test_resolution_exact(spark):
    groups = extraction.group_exact(candidates(spark, [("Personal Data", "Asset"), ("personal data.", "Asset"), ("Personal Data", "Risk")]))
    got = sorted((r["canonical_name"], r["entity_type"], r["n_mentions"]) for r in groups.collect())
    assert got == [("Personal Data", "Asset", 2), ("Personal Data", "Risk", 1)]
    old = spark.createDataFrame([("PERSONAL DATA", "Asset", 0), ("personal-data", "Asset", 1), ("Personal data", "Asset", 2)], "name string, entity_type string, pos long")
    merged = {r["entity_type"]: (r["canonical_name"], r["is_new"]) for r in extraction.match_exact(groups, old).collect()}
    assert merged == {"Asset": ("Personal data", False), "Risk": ("Personal Data", True)}


def test_resolution_similar_is_not_transitive(spark):
    import math

    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows = [(0, "Risk", at(0)), (1, "Risk", at(20)), (2, "Risk", at(40)), (3, "Role", at(0)), (4, "Risk", at(300))]
    df = spark.createDataFrame(rows, "pos long, entity_type string, embedding array<double>")
    got = {r["pos"]: r["leader_pos"] for r in extraction.absorb_greedily(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    old = spark.createDataFrame([("far", "Risk", 0, at(90)), ("near", "Risk", 1, at(5)), ("tie", "Risk", 2, at(5)), ("other", "Role", 3, at(1))], "name string, entity_type string, pos long, embedding array<double>")
    best = {r["pos"]: r["existing_name"] for r in extraction.match_similar(df, old).collect()}
    assert best == {0: "near", 1: "near", 3: "other"}


def test_stemmed_postings(spark):
    df = spark.createDataFrame([(0, "hopping the hops"), (1, None)], "id long, text string")
    got = sorted(map(tuple, search.stemmed(search.postings(df)).collect()))
    assert got == [(0, 0, "hop"), (0, 2, "hop")]


def test_register_skips_known_contents(spark):
    up = spark.createDataFrame([(2, "b.txt", "x"), (1, "a.txt", "x"), (3, "c.txt", "y")], "doc_id long, filename string, content string")
    first = ingest.register(up)
    assert sorted((r["doc_id"], r["minio_object_key"].split("/")[1]) for r in first.collect()) == [(1, "a.txt"), (3, "c.txt")]
    assert ingest.register(up, first).count() == 0


def test_retries():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise adapters.RateLimited
        return "ok"

    assert adapters.persistent(flaky, adapters.DELAYS, slept.append) == "ok" and slept == [5.0, 10.0]
    with pytest.raises(adapters.RateLimited):
        adapters.persistent(lambda: (_ for _ in ()).throw(adapters.RateLimited), (1.0,), slept.append)


def test_embedding_adapter(spark):
    df = spark.createDataFrame([(0, "a b"), (1, None)], "k long, t string")
    got = {r["id"]: r["embedding"] for r in adapters.embed_column(df, "k", "t", adapters.HashEmbedder(8)).collect()}
    assert got[0] == adapters.HashEmbedder(8).embed(["a b"])[0] and set(got[1]) == {0.0}


def test_incremental_ingest(spark, tmp_path):
    from heddle.plans.jobs import stage
    from heddle.streaming import ingest as stream

    landing, target = tmp_path / "landing", str(tmp_path / "lake")
    landing.mkdir()
    (landing / "one.txt").write_text("preamble\n# A.5 Policy\nbody\n## A.5.1 Review\nyearly\n")
    go = lambda: stream.start(spark, str(landing), target, str(tmp_path / "ck")).awaitTermination()
    go()
    (landing / "two.txt").write_text((landing / "one.txt").read_text())
    (landing / "three.txt").write_text("# 4.1 Scope\nall\n")
    go()
    go()
    assert spark.read.parquet(f"{target}/documents").count() == 2
    paths = sorted(r["path"] for r in spark.read.parquet(f"{target}/chunks").collect())
    assert paths == ["one.a_5", "one.a_5.a_5_1", "three.4_1"]
    log = str(tmp_path / "log")
    with pytest.raises(ZeroDivisionError), stage(spark, log, "d", "parse"):
        1 / 0  # noqa: B018
    with stage(spark, log, "d", "parse"):
        pass
    seen = [(r["status"], r["error_message"]) for r in spark.read.parquet(log).orderBy("at").collect()]
    assert seen == [("running", None), ("failed", "division by zero"), ("running", None), ("success", None)]


def test_similar_pairs_need_no_query_set(spark):
    from heddle.operators import search

    rows = [(i, [1.0, 0.1 * (i % 7)], i % 2) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label long")
    got = sorted((r["a"], r["b"]) for r in search.similar_pairs(df, 0.3, block=4).collect())
    assert got == [(a, b) for a in range(1, 31) for b in range(a + 1, 31) if a % 2 == b % 2]
