"""Search terms: accents folded, stop words, and a suffix stemmer."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common English function words; an index takes any other list as a parameter.
STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can
    cannot could did do does doing down during each few for from further had has have having he her here hers him his how i if in
    into is it its itself me more most my no nor not of off on once only or other our ours out over own same she should so some such
    than that the their theirs them then there these they this those through to too under until up very was we were what when where
    which while who whom why with would you your yours""".split()
)


def _accents() -> tuple[str, str]:
    """Letters that decompose into a basic letter and marks, and those letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _accents()


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks, whether composed or followed by them."""
    return F.regexp_replace(F.translate(text, _MARKED, _BARE), "[\\u0300-\\u036f]", "")


def terms(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of a-z after folding accents, but for stop words."""
    found = F.regexp_extract_all(F.lower(fold_accents(text)), F.lit("[a-z]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found



def _shape(stem: str) -> str:
    """c for consonants and v for vowels; y is a vowel behind a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


# The suffixes of Porter's published algorithm.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a lower-case English word, by Porter's algorithm."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = _longest(word, ("ed", "ing"))
        if cut and "v" in _shape(word[: -len(cut)]):
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        cut = _longest(word, table)
        if cut and _measure(word[: -len(cut)]):
            word = word[: -len(cut)] + table[cut]
    cut = _longest(word, _STEP4)
    if cut and _measure(word[: -len(cut)]) > 1 and (cut != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(cut)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem(term: Column) -> Column:
    """Porter stems, in Arrow batches; meant for distinct terms."""

    def each(values):
        return values.map(porter, na_action="ignore")

    return F.pandas_udf(each, "string")(term)
