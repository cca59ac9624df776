"""Graphemes to phonemes: vowelled Arabic text to a phoneme sequence with | between words.

A text is cut into clusters of a letter and its marks. Each kind of letter has a rule over its own marks, the
phonemes so far and the clusters ahead, which it may use up.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

# Letters, marks and their phonemes.
CONSONANTS = {
    "ء": "<", "ب": "b", "ت": "t", "ث": "^", "ج": "j", "ح": "H", "خ": "x", "د": "d", "ذ": "*", "ر": "r", "ز": "z", "س": "s", "ش": "$", "ص": "S",
    "ض": "D", "ط": "T", "ظ": "Z", "ع": "E", "غ": "g", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y",
}
VOWELS = {"َ": ["a"], "ُ": ["u"], "ِ": ["i"], "ً": ["a", "n"], "ٌ": ["u", "n"], "ٍ": ["i", "n"]}
SHADDA, SUKUN, MADDAH, HAMZA, SMALL_ALEF = "ّ", "ْ", "ٓ", "ٔ", "ٰ"
LONG = {"a": "اى", "u": "و", "i": "ي"}
SEATS = {"أ": ["a"], "إ": ["i"], "ؤ": [], "ئ": [], "ء": []}

_DROPPED = re.compile("[ۖ-ۭـ﻿]")
_CLUSTER = re.compile(f"([^\\W\\d_]|[ ])([ً-ٔ{SMALL_ALEF}]*)|([ً-ٔ{SMALL_ALEF}]+)")


def vowel(marks: str) -> list[str] | None:
    """Phonemes of the last short vowel or tanween among the marks; none if there is none."""
    return next((VOWELS[m] for m in reversed(marks) if m in VOWELS), None)


def _seat(letter: str, marks: str) -> list[str]:
    """A hamza with its vowel; alef seats have a vowel of their own unless silenced."""
    own = vowel(marks)
    return ["<"] * (1 + (SHADDA in marks)) + (own if own is not None else [] if SUKUN in marks else SEATS[letter])


def _late(marks: str) -> list[str]:
    return [{MADDAH: "aa", HAMZA: "<"}[m] for m in marks if m in (MADDAH, HAMZA)]


def phonemes(text: str) -> str:
    clusters = [(m[1] or "", m[2] if m[1] else m[3]) for m in _CLUSTER.finditer(_DROPPED.sub("", text).strip())]
    clusters += [("", "")] * 2
    out: list[str] = []
    at = 0
    while at < len(clusters) - 2:
        letter, marks = clusters[at]
        after, after_marks = clusters[at + 1]
        at += 1
        if letter == " ":
            out += ["|"] if out and out[-1] != "|" else []
        elif letter == "آ":
            out += ["<", "aa"]
        elif letter in SEATS:
            out += _seat(letter, marks)
            if letter == "أ" and after == "ا" and out[-1] == "a":
                out[-1] = "aa"
                at += 1
        elif letter == "ٱ":
            out += ["aa"] if SMALL_ALEF in marks else (vowel(marks) or ["a"])[:1]
            beyond, beyond_marks = clusters[at + 1] if after else ("", "")
            if after == "ل" and not after_marks.strip(SUKUN) and beyond in CONSONANTS and SHADDA in beyond_marks:
                at += 1  # the article's lam is heard as the letter after it
        elif letter == "ة":
            own = vowel(marks)
            out += ["h"] if own is None else ["t", *own]
        elif letter == "ى":
            out.append("aa")
        elif letter == "ا":
            own = vowel(marks)
            if marks[:1] == MADDAH:
                out += ["<", "aa"]
            elif marks[:1] == HAMZA:
                out += ["<", *(own or [])]
            elif own:
                out += own
            elif out and out[-1] == "a":
                out[-1] = "aa"
        elif letter in CONSONANTS:
            out += [CONSONANTS[letter]] * (1 + (SHADDA in marks))
            own = vowel(marks)
            if SMALL_ALEF in marks:
                out.append("aa")
            elif own and len(own) == 2:
                out += own
                at += own[0] == "a" and after == "ا"
            elif own:
                voiced = set(after_marks) & {SHADDA, *VOWELS}
                if after and after in LONG[own[0]] and (own[0] == "a" or not voiced):
                    out.append(own[0] * 2)
                    at += 1
                else:
                    out += own
            out += _late(marks)
        elif not letter:
            for m in marks:
                if m == SMALL_ALEF and out and out[-1] == "a":
                    out[-1] = "aa"
                elif m in (SMALL_ALEF, MADDAH, HAMZA):
                    out.append("<" if m == HAMZA else "aa")
    while out and out[-1] == "|":
        out.pop()
    return " ".join(out)


def phonemes_udf():
    """Arrow UDF; made on call, as it needs an active Spark."""

    @F.pandas_udf("string")
    def udf(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else phonemes(t))

    return udf
