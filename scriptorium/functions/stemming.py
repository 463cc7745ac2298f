"""English stems (the Snowball English algorithm, published by M. Porter) and stop words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
_VOWEL = "[aeiouy]"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words that the algorithm treats apart.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(word: str) -> tuple[int, int]:
    m = re.match(r"gener|commun|arsen", word)
    if m:
        r1 = m.end()
    else:
        m = re.search(f"{_VOWEL}[^aeiouy]", word)
        r1 = m.end() if m else len(word)
    m = re.search(f"{_VOWEL}[^aeiouy]", word[r1:])
    return r1, r1 + m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _KEPT:
        return word
    word = re.sub(r"^'", "", word)
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        word = word[:-1]
    if word in _KEPT_LATER:
        return word.lower()
    # past and gerund
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", word)
    if m:
        if m[1] in ("eedly", "eed"):
            if m.start() >= r1:
                word = word[: m.start()] + "ee"
        elif re.search(_VOWEL, word[: m.start()]):
            word = word[: m.start()]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLES):
                word = word[:-1]
            elif _short_end(word) and r1 >= len(word):
                word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for end, new in _STEP2:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ogi" or word[at - 1 : at] == "l") and (end != "li" or word[at - 1 : at] in tuple("cdeghkmnrt")):
                word = word[:at] + new
            break
    for end, new in _STEP3:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                word = word[:at] + new
            break
    for end in _STEP4:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r2 and (end != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.lower()


def lex_english(text: str) -> list[str]:
    """lexemes.lex() without stop words, stemmed."""
    from scriptorium.functions.lexemes import lex

    return [stem(w) for w in lex(text) if w not in STOP_WORDS]


def stemmed(lexemes: Column) -> Column:
    """An array of lexemes without stop words, stemmed; batches of rows, one cache a worker."""

    @F.pandas_udf("array<string>")
    def made(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else [stem(w) for w in r if w not in STOP_WORDS])

    return made(lexemes)
