"""English stems and the terms of a text: the suffix rules of the second Porter stemmer."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stareflow.functions.text import in_slices

# The stop words and the suffix tables of the English stemmer.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when
    where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_OTHER}")
_SHORT = re.compile(f"(?:^|.*{_OTHER}){_VOWEL}[^aeiouywxY]$|^{_VOWEL}{_OTHER}$")


def _regions(word: str) -> tuple[int, int]:
    """Where the part behind the first vowel and consonant begins, and that part's own such place."""
    early = re.match("gener|commun|arsen", word)
    first = early.end() if early else (m.end() if (m := _REGION.search(word)) else len(word))
    second = m.end() if (m := _REGION.search(word, first)) else len(word)
    return first, second


def _ending(word: str, table) -> str:
    """The longest ending of a word that a table has."""
    return next((s for s in sorted(table, key=len, reverse=True) if word.endswith(s)), "")


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in _KEPT:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        word = word[:-1]
    if word in _KEPT_LATER:
        return word
    # past and continuous forms
    end = _ending(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(_VOWEL, word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.match(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # derived forms
    end = _ending(word, (*_STEP2, "ogi", "li"))
    if end and len(word) - len(end) >= r1:
        if end in _STEP2:
            word = word[: -len(end)] + _STEP2[end]
        elif end == "ogi" and word.endswith("logi") or end == "li" and word[-3:-2] and word[-3] in "cdeghkmnrt":
            word = word[: -(1 if end == "ogi" else 2)]
    end = _ending(word, (*_STEP3, "ative"))
    if end and len(word) - len(end) >= r1:
        if end in _STEP3:
            word = word[: len(word) - len(end)] + _STEP3[end]
        elif len(word) - len(end) >= r2:
            word = word[: -len(end)]
    end = _ending(word, (*_STEP4, "ion"))
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT.match(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


_WORD = re.compile(r"[^\W_]+")
#: Stems that a task keeps at most: words repeat, and most are short.
_MEMO, _MEMO_MOST = {}, 200_000


def terms(text: str | None) -> list[tuple[str, int]]:
    """(stem, place) of a text's words that are no stop words; all words count as places, from 1."""
    out = []
    for place, word in enumerate(_WORD.findall((text or "").lower()), 1):
        if word in STOP_WORDS:
            continue
        found = _MEMO.get(word)
        if found is None:
            found = stem(word)
            if len(_MEMO) < _MEMO_MOST and len(word) < 40:
                _MEMO[word] = found
        out.append((found, place))
    return out


_TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))]))
_ARROW = pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.int32()))]))


@F.arrow_udf(_TERMS)
def text_terms(text: pa.Array) -> pa.Array:
    """Each text's different terms with the places where they stand."""

    def found(texts: list[str | None]) -> pa.Array:
        out = []
        for one in texts:
            own: dict[str, list[int]] = {}
            for term, place in terms(one):
                own.setdefault(term, []).append(place)
            out.append([{"term": t, "places": p} for t, p in own.items()])
        return pa.array(out, _ARROW)

    return in_slices(text, found)
