"""English stems by the published Snowball rules (Porter 2), for words in lower case."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
#: Fixed values of the algorithm: words with stems of their own, words that stay, and words that stay once a plural is off.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Endings and what stands in their place, by step.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
ENDS_2, ENDS_3 = tuple(STEP_2), tuple(STEP_3)
_HEAD = re.compile("gener|commun|arsen")
_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_SHORT = re.compile(f"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$")
_VOWEL = re.compile(f"[{VOWELS}]")
_Y = re.compile(f"(?:^|(?<=[{VOWELS}]))y")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings: tuple[str, ...]) -> str:
    """The longest of the endings that the word has: most words have none, which one look at all tells."""
    return max((e for e in endings if word.endswith(e)), key=len) if word.endswith(endings) else ""


def stem(word: str) -> str:
    if word in SPECIAL:
        return SPECIAL[word]
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    w = _Y.sub("Y", w) if "y" in w else w
    head = _HEAD.match(w)
    r1 = head.end() if head else _after(w, 0)
    r2 = _after(w, r1)
    if "'" in w:
        w = w[: len(w) - len(_ending(w, ("'s'", "'s", "'")))]
    e = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: len(w) - len(e)] + "ee"
    elif e and _VOWEL.search(w[: len(w) - len(e)]):
        w = w[: len(w) - len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    e = _ending(w, ENDS_2)
    if e and len(w) - len(e) >= r1:
        before = w[: len(w) - len(e)]
        if not (e == "ogi" and before[-1:] != "l" or e == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + STEP_2[e]
    e = _ending(w, ENDS_3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: len(w) - len(e)] + STEP_3[e]
    e = _ending(w, STEP_4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: len(w) - len(e)]
    if w.endswith("e"):
        if len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()
