"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Arabic letters and marks that normalisation names.
ALEF, ALEF_MADDA, ALEF_WASLA, SMALL_ALEF = "ا", "آ", "ٱ", "ٰ"
YEH, FARSI_YEH, YEH_BARREE, ALEF_MAQSURA = "ي", "ی", "ے", "ى"
KAF, FARSI_KAF, WAW, TEH_MARBUTA, LAM = "ك", "ک", "و", "ة", "ل"
TATWEEL = "ـ"
INVISIBLE = "﻿‏‎"
DIACRITICS = "[ً-ٟ]"
ANNOTATIONS = "[ۖ-ۭ]"
NUMBERS = "[﴾﴿٠-٩۰-۹]"
PUNCTUATION = "[.,;:!?…،؛؟]"
HAMZA = "[ءأإئ]"
FOLDED_FROM, FOLDED_TO = "أإآٱةى", "ااااهي"
FOLDED_MARKS = "[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭـ]"


def collapse_ws(text: Column) -> Column:
    """One blank for each run of Unicode white space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_arabic(text: Column, diacritics: bool = True, markers: bool = True, verse_numbers: bool = True, tatweel: bool = True, small_letters: bool = True, punctuation: bool = True, collapse_whitespace: bool = True, strip_hamza: bool = False) -> Column:
    """The configurable rewrite pipeline; the order of its steps matters (alef with small alef before small alef alone)."""
    text = F.translate(text, INVISIBLE, "")
    if diacritics:
        text = F.regexp_replace(text, DIACRITICS, "")
        text = F.translate(text, ALEF_MADDA + ALEF_WASLA + "ٲٳ", ALEF * 4)
        text = F.regexp_replace(text, ALEF + SMALL_ALEF, ALEF)
        text = F.translate(text, SMALL_ALEF + FARSI_YEH + YEH_BARREE + FARSI_KAF, ALEF + YEH + YEH + KAF)
    if markers or small_letters:
        text = F.regexp_replace(text, ANNOTATIONS, "")
    if verse_numbers:
        text = F.regexp_replace(text, NUMBERS, "")
    if tatweel:
        text = F.translate(text, TATWEEL, "")
    if punctuation:
        text = F.regexp_replace(text, PUNCTUATION, "")
    if strip_hamza:
        text = F.translate(F.regexp_replace(text, HAMZA, ""), ALEF_MAQSURA, YEH)
        text = F.regexp_replace(text, f"{WAW}{ALEF}?{TEH_MARBUTA}", ALEF + TEH_MARBUTA)
        for found, put in ((YEH * 2, YEH), ("بصط", "بسط"), ("صيطر", "سيطر"), (ALEF + LAM * 2, ALEF + LAM)):
            text = F.regexp_replace(text, found, put)
    return collapse_ws(text) if collapse_whitespace else text


def fold_arabic(text: Column) -> Column:
    """The browser side's normaliser: marks go, letters are always folded, punctuation and digits stay."""
    return collapse_ws(F.translate(F.regexp_replace(text, FOLDED_MARKS, ""), FOLDED_FROM, FOLDED_TO))


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def despace(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def merge_marks(text: Column, marks: str = r"[ۖ-ۭ]") -> Column:
    """Attach words that are marks alone to the word before them."""
    return F.regexp_replace(text, f" (?={marks}+( |$))", "")


def localised_digits(text: Column, digits: str = "٠١٢٣٤٥٦٧٨٩") -> Column:
    return F.translate(text.cast("string"), "0123456789", digits)


def pad_key(group: Column, seq: Column, width: int = 3) -> Column:
    return F.concat(F.lpad(group.cast("string"), width, "0"), F.lpad(seq.cast("string"), width, "0"))


def highlight(tokens: Column, matched: Column) -> Column:
    """Words in order, those at the matched places (from 0) in brackets."""
    return F.array_join(F.transform(tokens, lambda w, i: F.when(F.array_contains(matched, i), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")


def map_tokens(tokens: Column, table: Column) -> Column:
    """Each token's words in a map of token to blank-separated words; unmapped tokens go."""
    return F.flatten(F.filter(F.transform(tokens, lambda t: F.split(table[t], " ")), lambda x: x.isNotNull()))


def ascii_only(text: Column) -> Column:
    """Printable ASCII characters alone."""
    return F.regexp_replace(text, "[^ -~]", "")
