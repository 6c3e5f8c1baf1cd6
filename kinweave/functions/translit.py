"""Devanagari to Latin: by rules, and by a learnt model of words and of grapheme units in context.

A word is cut into units by one regular expression: a consonant with its sign (or none), an independent vowel, a nasal,
a visarga, or any other character. Everything else reads units.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from typing import NamedTuple

# Devanagari letters and their Latin spellings.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ळ": "l", "\u0934": "l",
}
VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऍ": "e", "ऑ": "o"}
MATRAS = {"\u093e": "aa", "\u093f": "i", "\u0940": "ee", "\u0941": "u", "\u0942": "oo", "\u0943": "ri", "\u0947": "e", "\u0948": "ai", "\u094b": "o", "\u094c": "au", "\u0945": "e", "\u0949": "o"}
VIRAMA, NUKTA, NASALS, VISARGA = "\u094d", "\u093c", "\u0902\u0901", "\u0903"
DIGITS = {"०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9"}
#: Letters with a nukta, and further letters that only the learnt model reads.
NUKTA_CONSONANTS = {"\u0958": "q", "\u0959": "kh", "\u095a": "g", "\u095b": "z", "\u095c": "r", "\u095d": "rh", "\u095e": "f", "\u095f": "y"}
MORE_CONSONANTS = {"\u0929": "n", "\u0931": "r"}
SHORT = {"आ": "a", "ई": "i", "ऊ": "u", "\u093e": "a", "\u0940": "i", "\u0942": "u"}
#: Places of articulation by their class letter.
PLACES = {
    "k": "कखगघङ\u0958\u0959\u095a", "c": "चछजझञ\u095b", "t": "टठडढण\u095c\u095d", "d": "तथदधन\u0929",
    "p": "पफबभम\u095e", "y": "यरलवळ\u0934\u0931\u095f", "s": "शषसह",
}
LABIALS = "पफबभम"
WORD = re.compile("[\u0900-\u0963\u0971-\u097f\u200c\u200d]+")

_ALL = {**CONSONANTS, **NUKTA_CONSONANTS, **MORE_CONSONANTS}
_PLACE_OF = {c: p for p, letters in PLACES.items() for c in letters}
_RULE = re.compile(f"([{''.join(CONSONANTS)}])(?:([{''.join(MATRAS)}])|({VIRAMA})|(?=\\s|\\Z)|(.??))|([{''.join(MATRAS)}{VIRAMA}{''.join(VOWELS)}{NASALS}{VISARGA}]|\\d)", re.S)
_UNIT = re.compile(f"(?P<cons>[{''.join(_ALL)}])(?P<sign>[{''.join(MATRAS)}{VIRAMA}])?|(?P<vowel>[{''.join(VOWELS)}])|(?P<nasal>[{NASALS}])|(?P<visarga>{VISARGA})|(?P<any>.)", re.S)
_SINGLE = {**MATRAS, VIRAMA: "", **VOWELS, **dict.fromkeys(NASALS, "n"), VISARGA: "h", **DIGITS}


def by_rules(text: str) -> str:
    """A bare consonant carries "a" unless white space or the end follows; nuktas are not read."""

    def spell(m: re.Match) -> str:
        if m[5] is not None:
            return _SINGLE.get(m[5], m[5])
        return CONSONANTS[m[1]] + (MATRAS[m[2]] if m[2] else "" if m[4] is None else "a")

    return _RULE.sub(spell, text.replace(NUKTA, ""))


class Unit(NamedTuple):
    """kind: C bare consonant, M with a vowel sign, H with a virama, V vowel, N nasal, X visarga, U anything else."""

    key: str
    kind: str
    cons: str


def units(word: str) -> list[Unit]:
    """Grapheme units; a letter and a nukta are the nukta letter, joiners are not read."""
    s = re.sub("[\u200c\u200d]", "", word)
    for letter in NUKTA_CONSONANTS:
        s = s.replace(unicodedata.normalize("NFD", letter), letter)
    out = []
    for m in _UNIT.finditer(s.replace(NUKTA, "")):
        if m["cons"]:
            out.append(Unit(m[0], "H" if m["sign"] == VIRAMA else "M" if m["sign"] else "C", m["cons"]))
        else:
            out.append(Unit(m[0], {"vowel": "V", "nasal": "N", "visarga": "X", "any": "U"}[m.lastgroup], ""))
    return out


def kept(word: list[Unit], medial: bool) -> list[bool]:
    """Which bare consonants keep their vowel: never the last unit's; with `medial` none between two vowels, from the right."""
    keep = [u.kind == "C" and i + 1 < len(word) for i, u in enumerate(word)]

    def voiced(i: int, independent: bool) -> bool:
        return word[i].kind == "M" or (independent and word[i].kind == "V") or (word[i].kind == "C" and keep[i])

    for i in reversed(range(1, len(word) - 1) if medial else ()):
        if word[i].kind == "C" and voiced(i - 1, True) and voiced(i + 1, False):
            keep[i] = False
    return keep


def context(word: list[Unit], i: int, keep: list[bool]) -> str:
    """The key under which a model's tables hold what unit i becomes."""
    u, last = word[i], i + 1 == len(word)
    after = None if last else word[i + 1]
    if u.kind == "C":
        before = "^" if i == 0 else "v" if word[i - 1].kind in "CMV" else "h" if word[i - 1].kind == "H" else "n"
        return f"{before}|{'$' if last else after.kind + '$' * (i + 2 == len(word))}|{int(keep[i])}"
    if u.kind in "MV":
        return f"{u.key[-1]}|{'$' * last}"
    if u.kind == "N":
        return f"{u.key}|{'$' if last else _PLACE_OF.get(after.cons, 'v')}"
    return u.key


@dataclass
class Model:
    """Learnt spellings. lexicon: whole words; tables: cons, vowel, nasal, schwa (1 keeps the vowel) and other, by context;
    opts: schwa (medial vowels go), nasal (m before labials), short (long vowels written once) for the rest.
    """

    lexicon: dict[str, str] = field(default_factory=dict)
    tables: dict[str, dict] = field(default_factory=dict)
    opts: dict[str, bool] = field(default_factory=dict)

    def vowel(self, letter: str) -> str:
        return (SHORT.get(letter) if self.opts.get("short") else None) or MATRAS.get(letter) or VOWELS[letter]

    def by_option(self, word: list[Unit], i: int) -> str:
        """A unit that is no consonant, under the options alone."""
        u = word[i]
        if u.kind == "V":
            return self.vowel(u.key)
        if u.kind == "N":
            return "m" if self.opts.get("nasal") and i + 1 < len(word) and word[i + 1].cons and word[i + 1].cons in LABIALS else "n"
        return "h" if u.kind == "X" else u.key

    def spelled(self, word: list[Unit]) -> list[str]:
        """What each unit becomes."""
        keep, out = kept(word, bool(self.opts.get("schwa"))), []
        table = {n: self.tables.get(n, {}) for n in ("cons", "vowel", "nasal", "schwa", "other")}
        for i, u in enumerate(word):
            key = context(word, i, keep)
            if u.cons:
                tail = {"H": "", "C": "a" if u.kind == "C" and table["schwa"].get(key, keep[i]) else "", "M": ""}[u.kind]
                if u.kind == "M":
                    tail = table["vowel"].get(key, self.vowel(u.key[-1]))
                out.append(table["cons"].get(u.cons, _ALL[u.cons]) + tail)
            else:
                learnt = table[{"V": "vowel", "N": "nasal"}.get(u.kind, "other")].get(key)
                out.append(self.by_option(word, i) if learnt is None else learnt)
        return out

    def by_units(self, word: str) -> str:
        return "".join(self.spelled(units(word)))

    def word(self, word: str) -> str:
        return self.lexicon[word] if word in self.lexicon else self.by_units(word)

    def text(self, text: str) -> str:
        """Each run of Devanagari letters is a word; what stands between passes, digits in ASCII."""
        return WORD.sub(lambda m: self.word(m[0]), text).translate({ord(k): v for k, v in DIGITS.items()})
