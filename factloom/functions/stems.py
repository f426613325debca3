"""Stems of English words by the suffix rules of the Snowball family's English stemmer, worked out once for each distinct term."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouy"

# Words with stems of their own, words that stay, words at which the first step ends, beginnings with a region of their own.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
ENDED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")

# Suffixes that the second, third and fourth step replace where the whole suffix lies in the region.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_SHORT = re.compile(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$|^[{VOWELS}][^{VOWELS}]$")
_VOWEL = re.compile(f"[{VOWELS}]")


def _after(word: str, start: int) -> int:
    """Where the region behind the first consonant that follows a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(_SHORT.search(word))


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a word in lower case; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    # a y at the beginning or behind a vowel is a consonant
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in VOWELS):
            chars[i] = "Y"
    w = "".join(chars)
    begun = next((b for b in BEGINNINGS if w.startswith(b)), None)
    one = len(begun) if begun else _after(w, 0)
    two = _after(w, one)

    if (s := _longest(w, ("'", "'s", "'s'"))) is not None:
        w = w[: -len(s)]
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in ENDED:
        return w

    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= one:
            w = w[: -len(s)] + "ee"
    elif s and _VOWEL.search(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif one >= len(w) and _ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"

    s = _longest(w, SECOND)
    if s and len(w) - len(s) >= one and not (s == "ogi" and w[-4:-3] != "l") and not (s == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: -len(s)] + SECOND[s]
    s = _longest(w, THIRD)
    if s and len(w) - len(s) >= (two if s == "ative" else one):
        w = w[: -len(s)] + THIRD[s]
    s = _longest(w, FOURTH)
    if s and len(w) - len(s) >= two and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        at = len(w) - 1
        if at >= two or (at >= one and not _ends_short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stems(terms: pd.Series) -> pd.Series:
    return terms.map(stem, na_action="ignore")


def stemmed(counted: DataFrame, key: str) -> DataFrame:
    """Counts of terms (key, dl, term, tf; a null term for a document without any) as counts of stems.

    Every distinct term of the corpus is stemmed once; the stems are joined.
    """
    distinct = counted.select("term").where("term is not null").distinct()
    known = distinct.select("term", stems("term").alias("stem"))
    return counted.join(known, "term", "left").groupBy(key, "dl", F.col("stem").alias("term")).agg(F.sum("tf").cast("int").alias("tf"))
