"""The index tokenizer: case and diacritics folded, words split at anything but letters and digits, Porter stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_WORD = re.compile(r"[^\W_]+")


def fold_word(text: str) -> str:
    """Lower case, without combining marks."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def split(text: str) -> list[str]:
    """The words that ``tokens`` stems."""
    return _WORD.findall(fold_word(text or ""))


def tokens(text: str) -> list[str]:
    return [stem(w) for w in split(text)]


class _Word:
    """A word as the Porter algorithm sees it: which letters are consonants, and the measure of a part."""

    def __init__(self, text: str):
        self.text = text

    def consonant(self, i: int) -> bool:
        c = self.text[i]
        return c not in "aeiou" and not (c == "y" and i > 0 and self.consonant(i - 1))

    def shape(self, end: int) -> str:
        return "".join("c" if self.consonant(i) else "v" for i in range(end))

    def measure(self, end: int) -> int:
        return len(re.findall(r"v+c", self.shape(end)))

    def double(self, end: int) -> bool:
        return end > 1 and self.text[end - 1] == self.text[end - 2] and self.consonant(end - 1)

    def short(self, end: int) -> bool:
        return end > 2 and self.shape(end)[-3:] == "cvc" and self.text[end - 1] not in "wxy"


# Suffixes of steps 2, 3 and 4 and what they become.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _replaced(word: str, table: dict[str, str]) -> str:
    for n in range(min(len(word) - 1, 7), 1, -1):
        if word[-n:] in table:
            return word[:-n] + table[word[-n:]] if _Word(word).measure(len(word) - n) > 0 else word
    return word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The Porter stem of a lower-case word; words of one or two letters and others than a-z stay."""
    if len(word) < 3 or not re.fullmatch(r"[a-z]+", word):
        return word
    w = word
    # 1a: plurals
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b: -eed, -ed, -ing
    if w.endswith("eed"):
        if _Word(w).measure(len(w) - 3) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _Word(w).shape(len(w) - len(suffix)):
                w = w[: -len(suffix)]
                x = _Word(w)
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif x.double(len(w)) and w[-1] not in "lsz":
                    w = w[:-1]
                elif x.measure(len(w)) == 1 and x.short(len(w)):
                    w += "e"
                break
    # 1c: y after a vowel somewhere
    if w.endswith("y") and "v" in _Word(w).shape(len(w) - 1):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP2), STEP3)
    # 4: suffixes behind a stem of measure 2
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            cut = 3 if suffix in ("sion", "tion") else len(suffix)
            if _Word(w).measure(len(w) - cut) > 1:
                w = w[:-cut]
            break
    # 5: a last e, a double l
    if w.endswith("e"):
        m = _Word(w).measure(len(w) - 1)
        if m > 1 or (m == 1 and not _Word(w).short(len(w) - 1)):
            w = w[:-1]
    if w.endswith("ll") and _Word(w).measure(len(w)) > 1:
        w = w[:-1]
    return w
