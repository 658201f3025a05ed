"""The English (Porter2) stemmer, by the rules its author published: regions R1 and R2, then suffixes in six steps."""

from __future__ import annotations

import re
from functools import lru_cache

# --- fixed values of the algorithm
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
LATE_EXCEPTIONS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
    return found.end() if found else len(word)


def _ends_short(word: str) -> bool:
    """Ends in a short syllable: non-vowel, vowel, non-vowel other than w, x, Y; or a vowel and a non-vowel alone."""
    return bool(re.search(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", word) or re.fullmatch(f"[{VOWELS}][^{VOWELS}]", word))


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.removeprefix("'")
    w = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", w)
    early = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), "")
    r1 = len(early) if early else _region(w, 0)
    r2 = _region(w, r1)
    cut = _longest(w, ("'s'", "'s", "'"))  # step 0
    w = w[: len(w) - len(cut)]
    ending = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))  # step 1a
    if ending == "sses":
        w = w[:-2]
    elif ending in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif ending == "s" and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in LATE_EXCEPTIONS:
        return w
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))  # step 1b
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: len(w) - len(ending)] + "ee"
    elif ending and re.search(f"[{VOWELS}]", w[: len(w) - len(ending)]):
        w = w[: len(w) - len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:  # step 1c
        w = w[:-1] + "i"
    ending = _longest(w, (*STEP2, "ogi", "li"))
    at = len(w) - len(ending)
    if ending and at >= r1:
        if ending in STEP2:
            w = w[:at] + STEP2[ending]
        elif ending == "ogi" and w[:at].endswith("l"):
            w = w[:-1]
        elif ending == "li" and w[:at] and w[at - 1] in LI:
            w = w[:at]
    ending = _longest(w, (*STEP3, "ative"))
    at = len(w) - len(ending)
    if ending and at >= r1:
        if ending == "ative":
            w = w[:at] if at >= r2 else w
        else:
            w = w[:at] + STEP3[ending]
    ending = _longest(w, (*STEP4, "ion"))
    at = len(w) - len(ending)
    if ending and at >= r2 and (ending != "ion" or w[:at].endswith(("s", "t"))):
        w = w[:at]
    if w.endswith("e"):  # step 5
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
