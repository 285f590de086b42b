"""Porter's stemmer (1980), as an Arrow UDF meant for distinct words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiou"


def _shape(stem: str) -> str:
    """The stem as v and c, runs squeezed."""
    out = ""
    for i, ch in enumerate(stem):
        kind = "v" if ch in VOWELS or ch == "y" and i and stem[i - 1] not in VOWELS else "c"
        if not out or out[-1] != kind:
            out += kind
    return out


def _m(stem: str) -> int:
    return _shape(stem).count("vc")


def _cvc(w: str) -> bool:
    if len(w) < 3 or w[-1] in "wxy":
        return False
    is_v = lambda i: w[i] in VOWELS or w[i] == "y" and i and w[i - 1] not in VOWELS
    return not is_v(len(w) - 1) and bool(is_v(len(w) - 2)) and not is_v(len(w) - 3)


def _replace(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for old, new in rules:
        if w.endswith(old):
            stem = w[: -len(old)]
            return stem + new if _m(stem) > least else w
    return w


STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz" and _shape(w)[-1] == "c":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, sorted(STEP2, key=lambda r: -len(r[0])), 0)
    w = _replace(w, sorted(STEP3, key=lambda r: -len(r[0])), 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _m(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _m(stem) > 1 or _m(stem) == 1 and not _cvc(stem):
            w = stem
    if _m(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(porter, na_action="ignore")
