"""Stems of English words, by the published Porter 2 algorithm, and words that
are too common to search for."""

from __future__ import annotations

import re
from functools import lru_cache

# Stop words.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now""".split()
)
# Words with a stem of their own.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
UNCHANGED_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Endings and what they become.
SECOND = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

VOWEL = "aeiouy"
REGION = re.compile(r"[aeiouy][^aeiouy]")


def regions(w: str) -> tuple[int, int]:
    """Where the parts begin that endings may be taken from."""
    m = re.match(r"gener|commun|arsen", w)
    first = m.end() if m else m.end() if (m := REGION.search(w)) else len(w)
    m = REGION.search(w, first)
    return first, m.end() if m else len(w)


def short(w: str, first: int) -> bool:
    """A short syllable at the end, and nothing after it."""
    return first >= len(w) and bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


def longest(w: str, endings) -> str:
    return max((e for e in endings if w.endswith(e)), key=len, default="")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(r"(?<=[aeiouy])y", "Y", re.sub(r"^y", "Y", word.lstrip("'")))
    first, second = regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in UNCHANGED_LATER:
        return w

    end = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= first:
            w = w[: -len(end)] + "ee"
    elif end and re.search(r"[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif short(w, first):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"

    end = longest(w, (*SECOND, "ogi", "li"))
    if end and len(w) - len(end) >= first:
        if end in SECOND:
            w = w[: -len(end)] + SECOND[end]
        elif end == "ogi" and w[-4:-3] == "l":
            w = w[:-1]
        elif end == "li" and w[-3:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]

    end = longest(w, (*THIRD, "ative"))
    if end and len(w) - len(end) >= first:
        if end in THIRD:
            w = w[: -len(end)] + THIRD[end]
        elif len(w) - len(end) >= second:
            w = w[: -len(end)]

    end = longest(w, (*FOURTH, "ion"))
    if end and len(w) - len(end) >= second and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]

    if w.endswith("e") and (len(w) - 1 >= second or len(w) - 1 >= first and not short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.replace("Y", "y")


def short_end(w: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))
