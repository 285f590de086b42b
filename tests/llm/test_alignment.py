"""Cross-tokenizer alignment, against token by token work with the libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import token_alignment
from heddle.llm.common import tokenizer_path

TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("   \n\tabcEÉé.,|<>_½▁漢字\x00\x85　")), max_size=60)
FIXED = [
    "a", "", None, " ", "   ", " a ", " a  b\n c <s> </s> <unk> <|endoftext|>", "a▁b", "\0", "a\0 b", "x" * 3000, "漢字" * 2000 + " end", "a \n b", "a\n  b", "\n",
    "tab\t x", "　 x  y", "aéé́  ", "  lead", "word" * 300 + " " + "zqxj" * 400, "<0x41> x",
]


@pytest.fixture(scope="module")
def tokens():
    return token_alignment.tokens_of(token_alignment.VOCABULARY_A, token_alignment.VOCABULARY_B)


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(tokenizer_path(token_alignment.VOCABULARY_A))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_alignment.VOCABULARY_B))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}

    def bytes_b(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    def groups_of(text):
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        own_a, own_b = [bytes(byte[c] for c in a_lib.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
        if not text or not b"".join(own_a) == b"".join(own_b) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum(list(map(len, own_a))).tolist(), np.cumsum(list(map(len, own_b))).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            out.append((a[i:k], b[j:m]))
            i, j = k, m
        return out

    def results(texts):
        groups = [groups_of(t or "") for t in texts]
        links = [Counter((x, y) for a, b in g or () for x in a for y in b) for g in groups]
        held = Counter(pair for own in links for pair in own)
        top = Counter()
        for (a, _), n in held.items():
            top[a] = max(top[a], n)
        out = []
        for g, own in zip(groups, links):
            if g is None:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            best = sum(n for pair, n in own.items() if held[pair] == top[pair[0]])
            total = sum(n * held[pair] for pair, n in own.items())
            out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, total, hashlib.sha256(said.encode()).hexdigest()))
        return out

    return results


def of_one_slice(tokens, texts):
    s = token_alignment.Slice(tokens, [t or "" for t in texts])
    digests, (doc, pair, n) = s.digests(), s.pairs()
    held = Counter(pair.tolist())
    top = Counter()
    for p, k in held.items():
        top[p >> 32] = max(top[p >> 32], k)
    best, total = Counter(), Counter()
    for i, p, k in zip(doc.tolist(), pair.tolist(), n.tolist()):
        total[i] += held[p] * k
        best[i] += k * (held[p] == top[p >> 32])
    return [(int(s.n_a[i]), int(s.n_b[i]), int(s.n_groups[i]), int(s.n_links[i]), best[i], total[i], digests[i]) for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=5))
def test_slice_like_the_libraries(tokens, brute, texts):
    assert of_one_slice(tokens, texts) == brute(texts)


@pytest.mark.parametrize("links", [token_alignment.LINKS, 7])
def test_odd_texts(tokens, brute, monkeypatch, links):
    """Also where links are listed in many rounds, and large groups by their distinct ids."""
    monkeypatch.setattr(token_alignment, "LINKS", links)
    texts = FIXED if links > 7 else [t for t in FIXED if len(t or "") < 2000]
    assert of_one_slice(tokens, texts) == brute(texts)


def as_rows(df):
    names = [c.split()[0] for c in token_alignment.RESULT.split(", ")]
    assert df.columns == names
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(tuple(r[c] for c in order) for r in df.collect())


def test_odd_rows(odd, empty, texts, brute, monkeypatch):
    want = Counter((i, *r) for (i, _), r in zip(texts, brute([t for _, t in texts])))
    assert as_rows(token_alignment.token_alignment(odd)) == want
    assert token_alignment.token_alignment(empty).count() == 0


def test_counts_are_of_all_documents(spark, small, brute):
    """Slices and partitions don't matter: the whole table by brute force."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = Counter((i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows])))
    assert as_rows(token_alignment.token_alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want
    assert as_rows(token_alignment.query(spark, small)) == want
