"""The Porter stemmer of 1980, with the common extensions: a few irregular words, short words kept, -ies and -ied after one letter."""

from __future__ import annotations

#: Stems of irregular words.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Endings of steps 2 and 3 with what replaces them (measure above 0), and endings that step 4 cuts (measure above 1).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    shape = _shape(word)
    return shape == "vc" or (shape[-3:] == "cvc" and word[-1] not in "wxy")


def _replace(word: str, endings: dict[str, str], least: int) -> str:
    for end in sorted(endings, key=len, reverse=True):
        if word.endswith(end):
            body = word[: len(word) - len(end)]
            if end == "logi":
                body = word[:-1]
                return body if _measure(word[:-3]) > least else word
            return body + endings[end] if _measure(body) > least else word
    return word


def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            body = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(body):
                if body.endswith(("at", "bl", "iz")):
                    word = body + "e"
                elif _double(body) and body[-1] not in "lsz":
                    word = body[:-1]
                elif _measure(body) == 1 and _cvc(body):
                    word = body + "e"
                else:
                    word = body
                break
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    word = _replace(_replace(word, STEP2, 0), STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            body = word[: -len(end)]
            if _measure(body) > 1 and (end != "ion" or body.endswith(("s", "t"))):
                word = body
            break
    if word.endswith("e"):
        body = word[:-1]
        if _measure(body) > 1 or (_measure(body) == 1 and not _cvc(body)):
            word = body
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
