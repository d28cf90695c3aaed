"""The Snowball stemmer of English (Porter2), by its published rules."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
LONG_STARTS = ("gener", "commun", "arsen")
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_V}{_C}")
#: A short syllable at the end: consonant, vowel, consonant but w, x and Y; or a vowel and a consonant that are all.
_SHORT = re.compile(f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$")


def _longest(word: str, endings: object) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)  # type: ignore[attr-defined]


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    # a y that begins the word or follows a vowel is a consonant
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    long = next((p for p in LONG_STARTS if word.startswith(p)), None)
    r1 = len(long) if long else _after(word, 0)
    r2 = _after(word, r1)

    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word

    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and re.search(_V, word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    ending = _longest(word, STEP_2)
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if not (ending == "ogi" and not before.endswith("l")) and not (ending == "li" and before[-1:] not in tuple(LI_ENDINGS)):
            word = before + STEP_2[ending]

    ending = _longest(word, STEP_3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + STEP_3[ending]

    ending = _longest(word, STEP_4)
    if ending and len(word) - len(ending) >= r2 and not (ending == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(ending)]

    at = len(word) - 1
    if word[-1] == "e" and (at >= r2 or (at >= r1 and not _SHORT.search(word[:-1]))) or word[-1] == "l" and at >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.lower()
