"""A question end to end: context, facts, prompt, citations."""

from pyspark.sql import functions as F

from heddle.operators import answer, graph, search

EDGE = "edge_id string, source_type string, source_name string, relation_type string, target_type string, target_name string, chunk_id string, document_id string"


def chunks(spark):
    rows = [("c1", "a.txt", "Article 6", None, "a.one", "data kept by law"), ("c2", "a.txt", None, "Scope", "a.two", "data and more data"), ("c3", "b.txt", None, None, "b.one", "data"), ("c4", "b.txt", "1.2", None, "b.two", "else")]
    return spark.createDataFrame(rows, "chunk_id string, filename string, clause_number string, title string, path string, text string")


def edges(spark):
    rows = [
        ("e1", "Control", "access", "REQUIRES", "Role", "owner", "c1", "d1"),
        ("e2", "Role", "owner", "PART_OF", "Clause", "o'clock", "c4", "d2"),
        ("e3", "Clause", "o'clock", "PART_OF", "Standard", "iso", "gone", "d3"),
        ("e4", "Risk", "loss", "PART_OF", "Standard", "far", "c3", "d3"),
    ]
    return spark.createDataFrame(rows, EDGE)


def ranking(spark, *ids):
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, rank int")


def ask(spark, *rankings, **kw):
    return answer.answer_question("why?", [ranking(spark, *r) for r in rankings], chunks(spark), edges(spark), search.overlap_score(["data"]), **kw)


def test_prompt_citations_and_answer(spark):
    found = ask(spark, ("c1", "lost", "c2"), ("c3", "c1"), top_n=2)
    row = found.answer.first()
    # c3 is one word, data; c2 has two of four words; c1 one of four, so it isn't in the context
    assert row["prompt"] == "Excerpts:\n\n[1] (chunk 1) data\n\n[2] (Scope) data and more data\n\nGraph-derived facts:\n\n[c3] Risk:'loss' --PART_OF--> Standard:'far'\n\nQuestion: why?"
    assert row["answer"] == "(chunk 1) data"
    assert [(r["ordinal"], r["chunk_id"], r["filename"], r["rank"]) for r in found.citations.orderBy("ordinal").collect()] == [(1, "c3", "b.txt", 0), (2, "c2", "a.txt", 1)]


def test_chunks_that_only_facts_mention_come_last(spark):
    found = ask(spark, ("c1",))
    # two hops from access and owner; the fact of the chunk that is gone is neither shown nor cited
    facts = [r["fact"] for r in found.facts.orderBy("place").collect()]
    assert facts == ["[Article 6] Control:'access' --REQUIRES--> Role:'owner'", "[1.2] Role:'owner' --PART_OF--> Clause:\"o'clock\""]
    assert [(r["ordinal"], r["chunk_id"], r["rank"]) for r in found.citations.orderBy("ordinal").collect()] == [(1, "c1", 0), (2, "c4", None)]


def test_nothing_found_asks_nobody(spark):
    class Never:
        def answer(self, prompt, max_tokens):
            raise AssertionError

    found = ask(spark, (), ("lost",), answerer=Never())
    assert [r["answer"] for r in found.answer.collect()] == [answer.NOTHING_FOUND]
    assert found.citations.isEmpty() and found.facts.isEmpty()


def test_an_answerer_gets_prompt_and_limit(spark):
    class Echo:
        def answer(self, prompt, max_tokens):
            return f"{max_tokens}: {prompt[-4:]}"

    assert ask(spark, ("c1",), answerer=Echo()).answer.first()["answer"] == "1024: why?"


def test_a_walk_with_enough_has_the_same_first_facts(spark):
    e = edges(spark)
    seed = spark.createDataFrame([("Control", "access"), ("Role", "owner")], "entity_type string, name string")
    whole = graph.expand_hops(e, seed, 3)
    for cap in (1, 2, 3, 9):
        part = graph.expand_hops(e, seed, 3, enough=cap)
        rows = lambda df: [tuple(r) for r in graph.capped_facts(df, cap).collect()]  # noqa: E731,B023
        assert rows(part) == rows(whole)
    assert graph.expand_hops(e, seed, 3, enough=1).agg(F.max("hop")).first()[0] == 1
