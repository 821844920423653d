"""Tokens and stems for the search index."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .stemmers import STEMMERS

#: Languages with a stemmer in the index; Catalan, Finnish and Romanian have no rules here and keep their tokens.
STEM_LANGUAGES = ("ca", "da", "nl", "en", "fi", "fr", "de", "it", "no", "pt", "ro", "ru", "es", "sv")


def tokenize(text: Column) -> Column:
    """Distinct lower-case runs of letters, 2 to 40 characters long, in order of appearance."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda x: F.char_length(x).between(2, 40))


def base_language(locale: Column) -> Column:
    return F.lower(F.substring(locale, 1, 2))


def same_language(a: Column, b: Column) -> Column:
    return base_language(a) == base_language(b)


# English: Porter2, from its published description. Endings and exceptions.
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(i: int) -> int:
        m = re.compile(r"[aeiouy][^aeiouy]").search(w, i)
        return m.end() if m else len(w)

    lead = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), "")
    r1 = len(lead) if lead else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


@lru_cache(100_000)
def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    if word in _INVARIANT:
        return word
    w = word.lstrip("'")
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w.replace("Y", "Y"))
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    m = re.search(r"(eedly|ingly|edly|eed|ing|ed)$", w)
    if m:
        end, stem = m.group(1), w[: m.start()]
        if end in ("eed", "eedly"):
            if m.start() >= r1:
                w = stem + "ee"
        elif re.search(r"[aeiouy]", stem):
            w = stem
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi"):
            w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@lru_cache(200_000)
def _stem_other(word: str, language: str) -> str:
    return STEMMERS[language](word)


def stem(word: str, language: str) -> str:
    """Languages without rules keep the lower-cased word."""
    word = word.lower()
    if language == "en":
        return stem_english(word)
    return _stem_other(word, language) if language in STEMMERS else word


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else stem(w, x or "") for w, x in zip(words, languages, strict=True)])


def stem_tokens(tokens: DataFrame, token: str = "token", language: str = "language") -> DataFrame:
    """Adds `stem`. Python sees each distinct word of a language once."""
    words = tokens.select(token, language).distinct()
    return tokens.join(words.withColumn("stem", stem_udf(token, language)), [token, language])
