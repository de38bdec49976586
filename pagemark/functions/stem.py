"""Stems by the published Snowball algorithms (English: Porter2, here), and language by alphabet."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .stem_more import stem_de, stem_ru

_V = "aeiouy"
# Fixed values of the published algorithm.
_EXCEPT = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": ""}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _after(word: str, start: int) -> int:
    m = re.compile(f"[{_V}][^{_V}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(f"(^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$", word))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem_en(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _EXCEPT:
        return _EXCEPT[word]
    w = word.removeprefix("'")
    w = re.sub(f"(^|(?<=[{_V}]))y", "Y", w)
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub("'s'$|'s$|'$", "", w)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _STAY:
        return w
    # Past forms and gerunds.
    if e := _longest(w, ("eedly", "eed")):
        if len(w) - len(e) >= r1:
            w = w[: len(w) - len(e)] + "ee"
    elif (e := _longest(w, ("ingly", "edly", "ing", "ed"))) and re.search(f"[{_V}]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    if (e := _longest(w, _STEP2)) and len(w) - len(e) >= r1:
        before = w[: -len(e)]
        if not (e == "ogi" and not before.endswith("l")) and not (e == "li" and not re.search("[cdeghkmnrt]$", before)):
            w = before + _STEP2[e]
    if (e := _longest(w, _STEP3)) and len(w) - len(e) >= r1 and (e != "ative" or len(w) - len(e) >= r2):
        w = w[: -len(e)] + _STEP3[e]
    if (e := _longest(w, _STEP4)) and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# The first alphabet that covers a word names its language.
_ALPHABETS = (("digits", "^[0-9]+$"), ("ru", "^[а-яё]+$"), ("en", "^[a-z]+$"), ("de", "^[a-zßẞäüö]+$"), ("fr", "^[a-zàâçéèêëîïôûùüÿñæœ]+$"))
_STEMMERS = {"ru": stem_ru, "en": stem_en, "de": stem_de}


def language(word: Column) -> Column:
    """The first alphabet that covers the word: digits, ru, en, de, fr; null if none does."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in _ALPHABETS:
        out = out.when(word.rlike(pattern), name)
    return out


def stem_word(word: str) -> str | None:
    """The stem of a Russian, English or German word, by its alphabet; None for others."""
    name = next((n for n, pattern in _ALPHABETS if re.fullmatch(pattern[1:-1], word)), None)
    return _STEMMERS[name](word) if name in _STEMMERS else None


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem_word, na_action="ignore")


def stem(word: Column) -> Column:
    """The stem of Russian, English and German words, else null; meant for distinct words."""
    return F.when(language(word).isin(*_STEMMERS), F.pandas_udf(_stems, StringType())(word))
