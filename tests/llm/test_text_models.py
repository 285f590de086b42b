"""Language ID, quality rules, importance resampling, HTML extraction and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heddle.llm import importance, langid, quality_rules, wrappers


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) > 100
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(odd, empty, texts):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(texts)
    by_id = {r["doc_id"]: r for r in rows}
    for i, t in texts:
        if not any(c.isalpha() for c in t or ""):
            assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["ambiguous"]) == ("und", 0.0, True)
        else:
            assert by_id[i]["lang_pred"] in ("en", "de")
    assert not by_id[None]["held_out"]
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6, 20])
def test_codewords_differ(k):
    code = langid.codewords(k)
    apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert len(code) == k and (not apart or min(apart) >= min(2 ** max(k - 2, 0), 5))


def base_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_base_figures_equal_brute_force(spark, odd, empty, texts, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for rows, want in ((quality_rules.judge(odd), texts), (quality_rules.query(spark, small), docs)):
        rows = rows.collect()
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
        assert got == Counter((i, *base_figures(t or "")) for i, t in want)
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.judge(empty).count() == 0


def test_divergence_by_hand():
    p, q = np.array([[1, 1, 0, 0]]), np.array([0.0, 0.0, 0.5, 0.5])
    assert quality_rules.distance(p, q)[0] == pytest.approx(1.0)
    assert quality_rules.distance(p, np.array([0.5, 0.5, 0, 0]))[0] == pytest.approx(0.0)


def test_rules_keep_good_and_drop_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.query(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, junk = [r["kept"] for r in got if r["quality"]], [r["kept"] for r in got if not r["quality"]]
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.4 * len(junk)


def test_reference_counts(spark, odd):
    refs = quality_rules.references(odd.select("text", "lang"))
    assert refs.languages == ["de", "en"]
    words = Counter(b for r in odd.where("lang = 'de'").collect() for w in (r["text"] or "").encode().split() if (b := quality_rules.bare(w)))
    place = refs.places["de"]
    assert all(refs.shares["de"][place[w]] == pytest.approx(words[w] / sum(words.values())) for w in list(place)[:20])


def test_importance_against_brute_force(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = importance.classify(docs, labels).collect()
    grams, texts = importance.Grams(), {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    own = {i: np.bincount(grams.buckets([t])[0], minlength=importance.BUCKETS) for i, t in texts.items()}
    ratio = importance.log_ratio(sum(own[i] for i in good), sum(own.values()))
    assert all(r["log_weight"] == pytest.approx(own[r["doc_id"]] @ ratio, abs=1e-6) for r in rows)
    n = labels.count()
    g = labels.where("quality = 1").count()
    k = math.ceil(min(1, g / n + 2 * math.sqrt(g * (n - g) / n**3)) * len(rows))
    order = sorted(rows, key=lambda r: -r["gumbel_key"])
    assert [r["kept"] for r in order] == [True] * k + [False] * (len(rows) - k)


def test_importance_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (12, 0, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert importance.classify(odd, labels).count() == 16
    assert importance.classify(odd, None).where("kept").count() >= 13
    assert importance.classify(odd, labels.where("false")).count() == 16
    assert importance.classify(empty, labels).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    keys = importance.sortable(np.r_[rng.normal(size=300), 0.0, -0.0, 1e300, -1e300, 0.5, 0.5])
    df = spark.createDataFrame([(int(x),) for x in keys], "_order long")
    for k in (1, 2, 150, len(keys)):
        assert importance.kth_largest(df, k) == sorted(keys.tolist())[-k]
    assert importance.kth_largest(df, len(keys) + 1) is None


PAGES = [
    (0, "http://a.example/1", "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li>m</ul></nav><article><h1>One &amp; two</h1><p>a  <b>b</b>\n c<p>d&nbsp;e</article><footer>f</footer>"),
    (1, "http://a.example/2", "<html><body><nav><ul><li>m<li>n</ul></nav><div class='ad'>buy<article><h1>Three</h1><p>x<div class='comments'><p>no</p></div></article></body>"),
    (2, "http://b.example/", "<body><header>Site</header><div class=menu>m</div><div id=c><h1>T</h1><p>first long text here</p><p>second long text here</p></div><aside>s</aside><form>q<input></form><div class='cookie-notice'>c</div>"),
    (3, "http://b.example/", None),
    (3, "http://b.example/", None),
    (4, None, ""),
    (None, "not a url", "plain &lt;text&gt; only <"),
    (5, "http://c.example", "<p>cut off <b>in the middle of a <a href='x"),
]
WANT = ["One & two\na b c\nd e", "Three\nx", "T\nfirst long text here\nsecond long text here", "", "", "", "plain <text> only <", "cut off in the middle of a"]


def test_pages(spark):
    df = spark.createDataFrame([(*p, 1, "s") for p in PAGES], "page_id long, url string, html string, salt int, host string")
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in wrappers.main_text(df).collect())
    assert got == Counter((i, u, t, len(t)) for (i, u, _), t in zip(PAGES, WANT, strict=True))
    assert wrappers.main_text(df.where("false")).count() == 0


def test_pages_against_a_plain_reading(spark, small):
    import html

    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in wrappers.query(spark, small).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", raw[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_chunks_of_a_host_do_not_matter(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    one, many = (sorted(map(str, wrappers.main_text(pages, c).collect())) for c in (1000, 2))
    assert one == many


def test_wrapper_has_slots_optionals_and_repeats():
    page = "<body><h1>{0}</h1><ul>{1}</ul>{2}<p>{0}</p></body>"
    sources = [page.format(i, "<li>x" * (i + 1), "<div>more</div>" if i == 1 else "") for i in range(3)]
    assert str(wrappers.extract(sources)[1]) == "<body><h1>#</h1><ul>(<li>#)+</ul>(<div>)?(#)?(</div>)?<p>#"


def test_pipeline_stages(spark, odd, empty, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for source in (docs, odd):
        cur = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            cur = stage(spark, cur, small)
            assert cur.columns == source.columns
    kept = corpus_pipeline.quality(spark, docs, small)
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in verdict.items() if k}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_pipeline_runs(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert rows and max(filled.values()) <= 4096


def one(*sources):
    return wrappers.extract(list(sources))[0]


def test_class_words_need_confirmation():
    article = "<article><h1>T</h1><section id='related-work'><p>earlier work</section><div id='search-methods'><p>we search</div></article>"
    assert one(f"<body><div class='layout has-sidebar'>{article}</div>") == ["T\nearlier work\nwe search"]
    # even a plain class word doesn't exclude what contains the article, or most of a page without one
    assert one(f"<body><div class='sidebar'><p>x</div><div class='widget'>{article}</div>") == ["T\nearlier work\nwe search"]
    assert one("<body><div class='search'><p>all that this page has to say</div><div class='ad'>buy</div>") == ["all that this page has to say"]
    assert one(f"<body><form id='aspnetForm'>{article}</form>") == ["T\nearlier work\nwe search"]
    # a part that one page of many has is no part of their template; one that several have is
    plain = [f"<article><p>page {i} has this</p></article>" for i in range(5)]
    noted = "<article><p>own</p><section class='notice'><p>kept</p></section></article>"
    assert one(*plain, noted)[-1] == "own\nkept"
    assert one(*plain, noted, noted.replace("own", "other"))[-2:] == ["own", "other"]


def test_math_and_object_text_stays():
    assert one("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <object data='a.png'>as shown</object>.</article>") == ["so x=2 holds as shown."]


def test_head_without_end_tag():
    for start in ("<body>", "", "<body class='x'><div>", "<b></b>"):
        assert one(f"<html><head><meta charset=u><title>t</title><style>p{{}}</style>{start}<article><p>all of this</article>") == ["all of this"]
    assert one("<head><title>t</title>\nloose text<p>and more") == ["loose text\nand more"]
    assert one("<head><meta charset=u><article><p>a</article><head><p>b") == ["a"]


def test_equal_texts_of_a_slot_are_template():
    page = "<article><h1>Title {0}</h1><p>Posted by our staff</p><p>the words of page number {0}</p><p>more of it {0}</p><p>Call us now</p></article>"
    want = [f"Title {i}\nthe words of page number {i}\nmore of it {i}" for i in range(6)]
    assert one(*(page.format(i) for i in range(6))) == want
    # copies of one page are no evidence, and neither are few pages
    assert all("Call us now" in t for t in one(*([page.format(0)] * 9 + [page.format(1)])))
    # a text that another page changes is data
    got = one(*(page.format(i) for i in range(5)), page.format(5).replace("now", "later"))
    assert all("Call us" in t and "Posted" not in t for t in got)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i)} {chr(0x5E00 + i)} " * 30, f"l{i:03}") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = [r[2] for r in rows]
    assert list(langid.gram_counts(docs)) == want
    assert quality_rules.references(docs).languages == want
