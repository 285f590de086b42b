"""Main text of web pages by union-free regular-expression inference.

Pages of a host come from a few templates.  Each page becomes a stream of block
tags and text slots; repetitions in it are folded into repeated groups.  A
wrapper starts as one page's stream and is aligned with the next ones: what
only one side has becomes optional, a group that either side repeats becomes
repeated (Crescenzi, Mecca and Merialdo, 2001).  There are no disjunctions.
Texts that the alignment puts in one place are compared over the pages: equal
ones are template, differing ones make a slot.  The main text is that of the
slots in the main region: the article if there is one, else the smallest
container that holds most of the varying text outside menus, adverts and the like.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own, table

#: Pages from which one wrapper is inferred; a host with more gets several.
CHUNK = 64
#: Hosts are counted in so many hashed bins.
HOST_BINS = 1 << 16
#: Longest group whose repetition is looked for; share of the varying text that the main container holds.
LONGEST_GROUP, MAIN_SHARE = 12, 0.6

RAW = "script|style|noscript|template|textarea|iframe|svg|title|select"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*>|(?P<text>[^<]+|<)",  # a tag that the page's end cuts is no text
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object
    math semantics annotation annotation-xml merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup
    mtable mtd mtext mtr munder munderover""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same kind ends.
SIBLINGS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Block elements whose start tag ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements whose end tag may be left out; it is no token, then.
LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot body html head".split())
APART_TAGS = frozenset("nav footer aside button dialog menu head fieldset input".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
APART_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts
    popup modal overlay newsletter subscribe subscription signup sidebar related recommended recommendations trending share sharing social comment comments
    disqus respond reply replies nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar pagination pager paging widget widgets login search""".split()
)
#: Words that say nothing beside those of APART_WORDS; with any other word ("related-work", "has-sidebar") a class is no evidence.
NEUTRAL_WORDS = frozenset(
    """area bar block bottom box btn button buttons container count desktop div entry feed form global group header icon icons id inner item items js left link links list
    local mobile module outer page panel post posts primary right s secondary section site slot story stories tag tags text title top unit wrap wrapper""".split()
)
#: Pages of a group on which such an element must stand, or half of them, to be part of the template.
CONFIRMING_PAGES = 2
#: Different pages that must have a slot before its equal texts count as template; share of a page's main text that may go as template.
TEMPLATE_PAGES, MOST_TEMPLATE = 4, 0.5
#: Elements that can stand in a head; any other one, or text, ends it.
HEAD_TAGS = frozenset("html head title base basefont bgsound link meta script style noscript template".split())
#: Parts that an article's start tag is taken to end where their own end tag is missing.
UNCLOSED = frozenset("nav header ad ads advert advertisement menu banner".split())


def words_of(attrs: str) -> tuple[frozenset[str], str, bool, bool]:
    """Telltale words of class and id; the class as written; whether the role is apart; whether the element is hidden."""
    words, label, role, hidden = set(), "", False, False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for token in value.split():
                runs = set(re.findall(r"[a-z]+", token))
                if runs and runs <= APART_WORDS | NEUTRAL_WORDS:
                    words |= runs & APART_WORDS
            label = label or value.strip()
        elif name == "role":
            role |= not APART_ROLES.isdisjoint(value.split())
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return frozenset(words), label, role, hidden


class Element:
    """An open element: ``apart`` for certain, or by ``evidence`` that other pages must confirm."""

    __slots__ = ("name", "label", "apart", "evidence", "within")

    def __init__(self, name: str, label: str, apart: bool, evidence: tuple[str, frozenset[str]] | None):
        self.name, self.label, self.apart, self.evidence = name, label, apart, evidence
        self.within = 0  # letters of text that isn't apart for certain


class Page:
    """A page as a stream of block tags and ``#`` for text, with the texts and where they stand."""

    __slots__ = ("stream", "texts", "regions", "paths")

    def __init__(self, source: str):
        self.stream: list = []
        self.texts: list[str] = []  # one for each "#"
        self.regions: list[tuple[str, ...] | None] = []  # containers of each text; None: apart from the main text
        self.paths: list[list[Element]] = []  # open elements of each text
        stack: list[Element] = []
        parts: list[str] = []

        def flush() -> None:
            if parts:
                if text := " ".join("".join(parts).split()):
                    self.stream.append("#")
                    self.texts.append(text)
                    self.paths.append(stack.copy())
                parts.clear()

        for m in TOKEN.finditer(source):
            if (text := m["text"]) is not None:
                if stack and stack[-1].name == "head" and not text.isspace():
                    stack.pop()
                parts.append(html.unescape(text))
                continue
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if stack and stack[-1].name == "head" and name not in HEAD_TAGS and not m["close"]:
                stack.pop()
            if name == "br":
                parts.append(" ")
                continue
            if name in INLINE:
                continue
            flush()
            if m["close"]:
                if name not in LOOSE:
                    self.stream.append(f"</{name}>")
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                continue
            attrs = m["attrs"]
            words, label, role, hidden = words_of(attrs) if attrs.strip(" /\n\t") else (frozenset(), "", False, False)
            self.stream.append(f"<{name} {label}>" if label else f"<{name}>")
            if name in VOID:
                continue
            if name in ENDS_P and stack and stack[-1].name == "p":
                stack.pop()
            if ends := SIBLINGS.get(name):
                while stack and stack[-1].name in ends:
                    stack.pop()
            if name in ("body", "html"):
                continue
            if name in ("article", "main"):
                while stack and (stack[-1].apart or stack[-1].evidence) and not UNCLOSED.isdisjoint(re.findall(r"[a-z]+", stack[-1].label)):
                    stack.pop()
            in_article = any(x.name == "article" for x in stack)
            apart = hidden or role or name in APART_TAGS or name == "header" and not in_article
            evidence = None
            if name == "form":
                evidence = (name, frozenset())
            elif name == "article":
                words &= {"comment", "comments", "reply", "related", "ad", "advert", "sponsored", "promo"}
            if words and name not in ("main", "p", "h1", "h2", "h3"):
                evidence = (name, words)
            stack.append(Element(name, f"{name} {label}".strip(), apart, evidence))
        flush()

    def evidence(self) -> set:
        """What says of elements with text that they are apart."""
        return {x.evidence for path in self.paths for x in path if x.evidence}

    def settle(self, confirmed: set) -> None:
        """Containers of each text, once it is known which evidence the other pages confirm.

        Evidence never counts against an element that contains the main article
        (the one of the most text) or else the main element; on pages without
        both, against one that contains most of the text.
        """
        total = 0
        for text, path in zip(self.texts, self.paths, strict=True):
            if not any(x.apart for x in path):
                total += len(text)
                for x in path:
                    x.within += len(text)
        best: tuple = (0, 0, 0)
        safe: set[int] = set()
        for path in self.paths:
            for i, x in enumerate(path):
                if x.name in ("article", "main") and (rank := (x.evidence is None, x.name == "article", x.within)) > best and x.within:
                    best, safe = rank, set(map(id, path[: i + 1]))
        if not safe:
            safe = {id(x) for path in self.paths for x in path if 2 * x.within > total}
        for path in self.paths:
            apart = any(x.apart or x.evidence in confirmed and id(x) not in safe for x in path)
            self.regions.append(None if apart else tuple(x.label for x in path))
        self.paths = []


def confirm(pages: list[Page]) -> set:
    """Evidence found on several pages of the group, or on half of them: then it marks a part of their template."""
    seen: dict[tuple, int] = defaultdict(int)
    for page in pages:
        for x in page.evidence():
            seen[x] += 1
    return {x for x, n in seen.items() if x[0] in ("form", "article") or n >= CONFIRMING_PAGES or 2 * n >= len(pages)}


def fold(stream: list, slots: list[int]) -> tuple[list, list[int]]:
    """Adjacent equal groups of tokens become one repeated group, a tuple; innermost groups first.

    ``slots`` has the number of texts that each token stands for.
    """
    changed = True
    while changed:
        changed = False
        for size in range(1, LONGEST_GROUP + 1):
            out: list = []
            sums: list[int] = []
            i, n = 0, len(stream)
            while i < n:
                j = i + size
                if j < n and stream[i] == stream[j] and (group := stream[i:j]) == stream[j : j + size]:
                    while stream[j : j + size] == group:
                        j += size
                    out.append(group[0] if size == 1 and type(group[0]) is tuple else tuple(group))
                    sums.append(sum(slots[i:j]))
                    i, changed = j, True
                else:
                    out.append(stream[i])
                    sums.append(slots[i])
                    i += 1
            stream, slots = out, sums
    return stream, slots


def absorb(stream: list, slots: list[int], groups: Iterable[tuple]) -> tuple[list, list[int]]:
    """Single occurrences of the given repeated groups become those groups."""
    for group in groups:
        n, first = len(group), group[0]
        if first not in stream:
            continue
        want, i = list(group), 0
        out: list = []
        sums: list[int] = []
        while i < len(stream):
            j = i + n if stream[i] == first and stream[i : i + n] == want else i + 1 if stream[i] == group else 0
            if j and out and out[-1] == group:
                sums[-1] += sum(slots[i:j])
            elif j:
                out.append(group)
                sums.append(sum(slots[i:j]))
            else:
                j = i + 1
                out.append(stream[i])
                sums.append(slots[i])
            i = j
        stream, slots = out, sums
    return stream, slots


class Wrapper:
    """A union-free regular expression: tokens and repeated groups, each of them optional or not."""

    def __init__(self):
        self.items: list = []
        self.optional: list[bool] = []
        self.groups: list[tuple] = []  # shortest first
        self.shapes: set[tuple] = set()

    def learn(self, folded: list) -> None:
        """Align with one more page's folded stream, and grow as far as it doesn't fit."""
        shape = tuple(folded)
        if shape in self.shapes:
            return
        first = not self.shapes
        self.shapes.add(shape)
        new = {x for x in folded if type(x) is tuple}.difference(self.groups)
        if new:
            self.groups = sorted([*self.groups, *new], key=lambda g: (len(g), str(g)))
        if first:
            self.items, self.optional = list(folded), [False] * len(folded)
            return
        if new:
            before = list(zip(self.items, self.optional, strict=True))
            self.items, _ = absorb(self.items, [0] * len(self.items), self.groups)
            self.optional = _carried(before, self.items)
        folded, _ = absorb(folded, [0] * len(folded), self.groups)
        items: list = []
        optional: list[bool] = []
        for what, a, b, c, d in SequenceMatcher(None, self.items, folded, autojunk=False).get_opcodes():
            if what == "equal":
                items += self.items[a:b]
                optional += self.optional[a:b]
            else:  # one side's tokens, then the other's, both optional
                items += self.items[a:b] + folded[c:d]
                optional += [True] * (b - a + d - c)
        self.items, self.optional = items, optional

    def places(self, folded: list, slots: list[int]) -> list[int | None]:
        """The wrapper's item behind each text of a page; None where the page doesn't fit."""
        folded, slots = absorb(folded, slots, self.groups)
        item: list[int | None] = [None] * len(folded)
        for a, b, n in SequenceMatcher(None, self.items, folded, autojunk=False).get_matching_blocks():
            item[b : b + n] = range(a, a + n)
        return [at for at, n in zip(item, slots, strict=True) for _ in range(n)]

    def __str__(self) -> str:
        show = lambda x: f"({''.join(map(show, x))})+" if type(x) is tuple else x
        return "".join(f"({show(x)})?" if o else show(x) for x, o in zip(self.items, self.optional, strict=True))


def _carried(before: list[tuple], items: list) -> list[bool]:
    """Which of ``items``, folded from ``before``, are optional: those with nothing obligatory behind them."""
    must = defaultdict(int)
    for x, o in before:
        must[x] += not o
    return [not (must[x] or type(x) is tuple and any(must[y] for y in x)) for x in items]


def main_region(pages: list[Page]) -> tuple[str, ...]:
    """For pages without article and main: the smallest container with most of the varying text."""
    seen: dict[tuple, set[str]] = defaultdict(set)
    mass: dict[tuple, int] = defaultdict(int)
    for page in pages:
        for text, region in zip(page.texts, page.regions, strict=True):
            if region is not None:
                seen[region].add(text)
    for region, texts in seen.items():
        if len(texts) > 1 or len(pages) == 1:
            for i in range(len(region) + 1):
                mass[region[:i]] += sum(map(len, texts))
    total = mass.get((), 0)
    good = [r for r, n in mass.items() if n >= MAIN_SHARE * total and (not r or r[-1].split(" ")[0] not in ("p", "li", "td", "h1", "h2", "h3", "blockquote"))]
    return max(good, key=lambda r: (len(r), mass[r])) if total and good else ()


def kind_of(region: tuple[str, ...] | None) -> str:
    """Whether a text stands in an article, in the main element, elsewhere, or apart."""
    if region is None:
        return "apart"
    names = {x.split(" ")[0] for x in region}
    return "article" if "article" in names else "main" if "main" in names else "rest"


def template_texts(pages: list[Page], items: list[list[int | None]]) -> dict[int, set[str]]:
    """Texts that are equal wherever pages fit a slot: they belong to the template, the differing ones are data.

    Pages of the same texts count once, or copies of a page would make all of it template.
    """
    seen: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    having: dict[int, int] = defaultdict(int)
    known: set[tuple] = set()
    for page, at in zip(pages, items, strict=True):
        if (key := tuple(page.texts)) in known:
            continue
        known.add(key)
        slots: dict[int, set[str]] = defaultdict(set)
        for text, i in zip(page.texts, at, strict=True):
            if i is not None:
                slots[i].add(text)
        for i, texts in slots.items():
            having[i] += 1
            for text in texts:
                seen[i][text] += 1
    return {i: same for i, n in having.items() if n >= TEMPLATE_PAGES and (same := {t for t, k in seen[i].items() if k == n})}


def without_template(texts: list[str], slots: list[int | None], template: dict[int, set[str]]) -> list[str]:
    """``texts`` without those of the template, unless that would take most of them."""
    left = [t for t, i in zip(texts, slots, strict=True) if t not in template.get(i, ())]
    return left if sum(map(len, left)) >= (1 - MOST_TEMPLATE) * sum(map(len, texts)) else texts


def extract(sources: list[str]) -> tuple[list[str], Wrapper]:
    """Main text of each page of one template group, and the wrapper that they fit.

    A slot of the wrapper belongs to the region where most of its text stands,
    over all pages of the group.
    """
    pages = [Page(s) for s in sources]
    confirmed = confirm(pages)
    for page in pages:
        page.settle(confirmed)
    wrapper, folded = Wrapper(), [fold(p.stream, [x == "#" for x in p.stream]) for p in pages]
    for stream, _ in folded:
        wrapper.learn(stream)
    known: dict[tuple, list[int | None]] = {}
    items = []
    for stream, slots in folded:
        shape = (tuple(stream), tuple(slots))
        if shape not in known:
            known[shape] = wrapper.places(stream, slots)
        items.append(known[shape])
    mass: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for page, at in zip(pages, items, strict=True):
        for text, region, i in zip(page.texts, page.regions, at, strict=True):
            if i is not None:
                mass[i][kind_of(region)] += len(text)
    slot_kind = {i: max(sorted(n), key=n.get) for i, n in mass.items()}
    template = template_texts(pages, items)
    rest = None
    out = []
    for page, at in zip(pages, items, strict=True):
        kinds = [
            "apart" if r is None else k if (k := kind_of(r)) == "article" else slot_kind.get(i, k) if k != "main" else k
            for r, i in zip(page.regions, at, strict=True)
        ]
        kinds = [k if k != "apart" or r is None else kind_of(r) for k, r in zip(kinds, page.regions, strict=True)]
        if "article" in kinds or "main" in kinds:
            want = "article" if "article" in kinds else "main"
            chosen = [j for j, k in enumerate(kinds) if k == want]
        else:
            if rest is None:
                rest = main_region([p for p in pages if all(kind_of(r) in ("rest", "apart") for r in p.regions)])
            chosen = [j for j, r in enumerate(page.regions) if r is not None and r[: len(rest)] == rest]
            chosen = chosen or [j for j, r in enumerate(page.regions) if r is not None]
        out.append("\n".join(without_template([page.texts[j] for j in chosen], [at[j] for j in chosen], template)))
    return out, wrapper


def main_text(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``.

    Null html counts as empty; a page without main text has the empty text.
    Pages whose url is null or has no host form a host of their own.  Tags that
    aren't closed, cut pages and stray marks do no harm beyond their block.
    Repeated rows and null ids give a row each; an empty table none; other
    columns are ignored.

    Pages meet once, by host and chunk of about ``chunk`` pages, so a host of
    any size is many small groups; which pages share a chunk follows from their
    ids.  Chunks come from counts in hashed bins: a table of fixed size.
    """
    rows = own(pages, "page_id", "url", "html").select(
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
    )
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("host"), F.lit(HOST_BINS)).cast("int"))
    chunks = rows.groupBy("bin").agg(F.ceil(F.count("*") / chunk).alias("chunks")).where("chunks > 1")
    salted = rows.join(F.broadcast(chunks), "bin", "left").select(
        "page_id", "url", "html", "host", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("chunks", F.lit(1))).alias("salt")
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["page_id", "url"], kind="stable")
        texts, _ = extract(group["html"].tolist())
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"], "text": texts, "n_chars": list(map(len, texts))})

    kind = pages.schema["page_id"].dataType.simpleString()
    return salted.groupBy("host", "salt").applyInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
