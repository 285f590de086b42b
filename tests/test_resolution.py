"""Entity resolution and the load of a graph, against the same work done one name after the other."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.operators import resolution


def one_by_one(pairs, n):
    """Leaders of n groups in order, from links (a, b)."""
    earlier = {}
    for a, b in pairs:
        earlier.setdefault(b, []).append(a)
    leader = {}
    for b in range(n):
        first = min((a for a in earlier.get(b, []) if leader[a] == a), default=b)
        leader[b] = first
    return {b: a for b, a in leader.items() if a != b}


@pytest.mark.parametrize("replay", [resolution.REPLAY, 30, 1])
def test_leaders_in_order(spark, replay):
    """All links replayed at once, small components replayed and large ones in rounds, and all in rounds."""
    rng = random.Random(replay)
    chain = [(i, i + 1) for i in range(12)]
    dense = [tuple(sorted(rng.sample(range(20, 60), 2))) for _ in range(120)]
    small = [tuple(sorted(rng.sample(range(k, k + 5), 2))) for k in range(100, 160, 5) for _ in range(5)]
    pairs = [*chain, *dense, *small, *small[:3]]
    rows = [(f"{a:04d}", f"{b:04d}") for a, b in pairs]
    got = {int(r["pos"]): int(r["leader_pos"]) for r in resolution.greedy_leaders(spark.createDataFrame(rows, "a string, b string"), replay).collect()}
    assert got == one_by_one(pairs, 160)
    assert got[1] == 0 and 2 not in got and got[3] == 2  # not a transitive closure


def letters(name):
    return np.array([name.lower().count(chr(c)) for c in range(97, 123)], dtype=float)


def similar(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / n), 6) if n else 0.0


def plain(name):
    return " ".join(re.sub(r"[^a-z0-9\s]", "", name.strip().lower()).split())


def in_sequence(candidates, existing, tau=0.9):
    """(key, type) -> (canonical name, is new), and the order of groups, by one loop after the other."""
    groups, order = {}, []
    for name, kind in candidates:
        if (plain(name), kind) not in groups:
            groups[plain(name), kind] = name
            order.append((plain(name), kind))
    known = {}
    for kind, name in sorted(existing):
        known[plain(name), kind] = name
    out, late, leaders = {}, [], []
    for g in order:
        if g in known:
            out[g] = (known[g], False)
        else:
            late.append(g)
    for g in late:
        near = [(-similar(letters(groups[g]), letters(name)), name) for kind, name in existing if kind == g[1]]
        near = [x for x in near if -x[0] >= tau]
        if near:
            out[g] = (min(near)[1], False)
            continue
        lead = next((x for x in leaders if x[1] == g[1] and similar(letters(groups[x]), letters(groups[g])) >= tau), g)
        if lead == g:
            leaders.append(g)
        out[g] = (groups[lead], True)
    first = [g for g in order if g not in late] + late
    place = {g: i for i, g in enumerate(first)}
    for g in late:  # an absorbed group stands where its leader does
        if out[g][1]:
            place[g] = place[next(x for x in leaders if groups[x] == out[g][0] and x[1] == g[1])]
    return out, place


def names_of(candidates, out, place):
    best = {}
    for name, kind in candidates:
        g = plain(name), kind
        if name not in best or place[g] >= best[name][0]:
            best[name] = (place[g], out[g][0])
    kinds = {}
    for g, (canonical, _) in out.items():
        if canonical not in kinds or place[g] >= kinds[canonical][0]:
            kinds[canonical] = (place[g], g[1])
    return {raw: (kinds[name][1], name) for raw, (_, name) in best.items()}


def as_candidates(spark, rows):
    return spark.createDataFrame([(f"{i:06d}", n, k) for i, (n, k) in enumerate(rows)], "pos string, name string, entity_type string")


def embed(names):
    return names.select("pos", X.letter_counts(F.col("name")).alias("embedding"))


def test_like_one_after_the_other(spark):
    rng = random.Random(4)
    stems = ["Personal Data", "Risk Register", "Asset List", "Data Owner", "Control Plan", "Audit Log"]
    change = [lambda s: s, str.upper, lambda s: s + ".", lambda s: s + "s", lambda s: s[::-1], lambda s: "  " + s.replace(" ", "  "), lambda s: s + " x", lambda s: s[1:]]
    rows = [(rng.choice(change)(rng.choice(stems)), rng.choice(["Asset", "Risk"])) for _ in range(150)]
    existing = [("Asset", "Personal Data"), ("Risk", "Data Personal"), ("Asset", "Registers Risk"), ("Asset", "Register Risks"), ("Role", "Audit Log")]
    old = spark.createDataFrame([(k, n, letters(n).tolist()) for k, n in existing], resolution.VERTICES)
    candidates = as_candidates(spark, [*rows, (None, "Asset"), ("Nobody", None)])
    resolved = resolution.resolve_entities(candidates, old, embed)
    out, place = in_sequence(rows, existing)
    assert {(r["key"], r["entity_type"]): (r["canonical_name"], r["is_new"]) for r in resolved.collect()} == out
    assert len({v[0] for v in out.values()}) < len(out) and {v[1] for v in out.values()} == {True, False}
    got = {r["raw_name"]: (r["entity_type"], r["canonical_name"]) for r in resolution.canonical_names(candidates, resolved).collect()}
    assert got == names_of(rows, out, place)


def test_an_exact_match_needs_no_embedding(spark):
    def refuse(names):
        assert names.count() == 0
        return embed(names)

    old = spark.createDataFrame([("Asset", "Personal Data", [1.0])], resolution.VERTICES)
    r = resolution.resolve_entities(as_candidates(spark, [("personal data.", "Asset")]), old, refuse).collect()
    assert [(x["canonical_name"], x["is_new"], x["embedding"]) for x in r] == [("Personal Data", False, None)]


MENTION = "source string, relation_type string, target string, chunk_id string, document_id string"


def load(spark, store, docs, rows, mentions):
    documents = spark.createDataFrame([(d,) for d in docs], "document_id string")
    return resolution.resolve_and_load(store, documents, as_candidates(spark, rows), spark.createDataFrame(mentions, MENTION), embed)


def stored(store):
    edges = Counter((r["source_type"], r["source_name"], r["relation_type"], r["target_type"], r["target_name"], r["chunk_id"], r["document_id"]) for r in store.edges().collect())
    return edges, Counter((r["entity_type"], r["name"]) for r in store.vertices().collect())


def test_load_is_idempotent_and_touches_only_its_documents(spark, tmp_path):
    store = resolution.StoredGraph(spark, f"file://{tmp_path}")
    rows = [("Alpha", "Risk"), ("Beta", "Control"), ("ALPHA", "Risk"), ("Lonely", "Role")]
    mentions = [("Alpha", "requires", "Beta", "c1", "d1"), ("ALPHA", "requires", "Beta", "c1", "d1"), ("Alpha", "requires", "Unknown", "c1", "d1"), ("Beta", "part_of", "Alpha", "c2", "d2")]
    load(spark, store, ["d1", "d2"], rows, mentions)
    first = stored(store)
    assert first[0] == Counter({("Risk", "Alpha", "REQUIRES", "Control", "Beta", "c1", "d1"): 2, ("Control", "Beta", "PART_OF", "Risk", "Alpha", "c2", "d2"): 1})
    assert first[1] == Counter({("Risk", "Alpha"): 1, ("Control", "Beta"): 1, ("Role", "Lonely"): 1})
    load(spark, store, ["d1", "d2"], rows, mentions)
    assert stored(store) == first
    files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("edges/bucket=*/*.parquet")}
    other = [p for p in files if p.parent.name != f"bucket={spark.range(1).select(F.pmod(F.xxhash64(F.lit('d1')), F.lit(resolution.BUCKETS))).first()[0]}"]
    load(spark, store, ["d1"], rows, [])  # the document says nothing any more
    assert stored(store) == (Counter({k: n for k, n in first[0].items() if k[-1] == "d2"}), first[1])
    assert other and all(p.exists() and p.stat().st_mtime_ns == files[p] for p in other)


def test_a_name_of_two_types_means_the_last(spark, tmp_path):
    store = resolution.StoredGraph(spark, f"file://{tmp_path}")
    load(spark, store, ["d"], [("Same", "Risk"), ("Other", "Role"), ("Same", "Asset")], [("Same", "maps_to", "Other", "c", "d")])
    assert [x[:2] for x in stored(store)[0]] == [("Asset", "Same")]


def test_empty_batch(spark, tmp_path):
    store = resolution.StoredGraph(spark, f"file://{tmp_path}")
    load(spark, store, [], [], [])
    assert stored(store) == (Counter(), Counter())
