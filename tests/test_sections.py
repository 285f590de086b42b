"""The page parser and what it feeds."""

from heddle.operators import sections

PAGES = [
    (1, "<html><head><title>no</title></head><body><nav><p>menu</p></nav><p>before</p><h1>One &amp; <i>only</i></h1><p>a <b>bold</b>\n word<p>left open<br>next"
        "<h2 class=x>Two</h2><div>in a div <span>and</span> more</div><script>var x = '<p>no</p>'</script><!-- <p>no</p> --><ul><li>first<li>second</ul>"
        "<H3>Three</H3><h2>Four &lt;x&gt; &amp;lt;</h2><p></p><p>1 < 2 and 3 > 2</p><footer>no</footer>"),
    (2, None), (3, ""), (4, "just text"), (5, "<h6>deep</h6>text<h1></h1>more"),
    (6, "<p>" + "<h2>t</h2>x y<p>z" * 20_000),
]


def parsed(spark):
    rows = [(i, h, 0, 1, "s") for i, h in PAGES]
    return sections.page_blocks(spark.createDataFrame(rows, "page_id long, html string, pos int, level int, text string"))


def test_blocks_and_sections(spark):
    got = {}
    for r in sorted(sections.block_sections(parsed(spark)).collect()):
        got.setdefault(r["doc_id"], []).append((r["pos"], r["level"], r["title"], r["text"]))
    assert got[1] == [
        (0, 1, "One & only", "a bold word\nleft open\nnext"),
        (1, 2, "Two", "in a div and more\nfirst\nsecond"),
        (2, 3, "Three", ""),
        (3, 2, "Four <x> &lt;", "1 < 2 and 3 > 2"),
    ]
    assert got[5] == [(0, 6, "deep", "text\nmore")]
    assert set(got) == {1, 5, 6} and len(got[6]) == 20_000 and set(x[3] for x in got[6]) == {"x y\nz"}


def test_sections_become_chunks(spark):
    from pyspark.sql import functions as F

    tree = sections.heading_tree(sections.block_sections(parsed(spark).where("doc_id = 1"))).withColumn("slug", F.lit("Page 1"))
    got = {r["pos"]: (r["path"], r["chunk_parent_pos"], r["order_in_parent"]) for r in sections.build_chunks(tree).collect()}
    assert got == {0: ("page_1.one_only", None, 0), 1: ("page_1.one_only.two", 0, 0), 3: ("page_1.one_only.four_x_lt", 0, 1)}


def test_parents_are_followed_to_any_depth(spark):
    n = 40
    rows = [(7, i, i + 1, f"t{i}", "x" if i in (0, n - 1) else "", "s") for i in range(n)]
    tree = sections.heading_tree(spark.createDataFrame(rows, "doc_id long, pos int, level int, title string, text string, slug string"))
    got = {r["pos"]: (r["path"], r["chunk_parent_pos"]) for r in sections.build_chunks(tree).collect()}
    assert got == {0: ("s.t0", None), n - 1: ("s." + ".".join(f"t{i}" for i in range(n)), 0)}


def test_paths_need_no_more_than_labels(spark):
    """One fold of labels by document, against a stack."""
    import random

    rng = random.Random(6)
    rows = [(d, i, rng.randrange(1, 5), rng.choice(["A", "B b", "1.2 c"]), rng.choice(["", "t"]), f"Doc {d}") for d in range(8) for i in range(rng.randrange(1, 30))]
    stack, want = [], set()
    for d, i, level, title, text, _slug in rows:
        stack = [s for s in stack if s[0] == d and s[2] < level]
        stack.append((d, i, level, {"A": "a", "B b": "b_b", "1.2 c": "1_2"}[title], text))
        if text:
            want.add((d, i, ".".join([f"doc_{d}", *(s[3] for s in stack)]), max((s[1] for s in stack[:-1] if s[4]), default=None)))
    tree = sections.heading_tree(spark.createDataFrame(rows, "doc_id long, pos int, level int, title string, text string, slug string"))
    assert {tuple(r) for r in sections.paths(tree).collect()} == want
