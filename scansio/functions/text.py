"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The diacritics that normalisation drops, the letters it unites, the signs it drops.
DIACRITICS = "\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E4\\u06E7\\u06E8\\u06EA-\\u06ED"
VARIANTS, UNITED = "أإآٱةى", "ااااهي"
DROPPED = "﻿ـ،؟.!:"
WORD_START = "▁"
PAUSE_MARKS = "\\u06D6-\\u06DC"
# The opening formula in normalised form, and the surahs whose first verse is not preceded by it.
OPENING = "بسم الله الرحمن الرحيم"
WITHOUT_OPENING = (1, 9)
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, f"[{DIACRITICS}]", "")


def normalize(c: Column) -> Column:
    """The canonical form: word starts to spaces, no diacritics, letter variants united, signs dropped, single spaces."""
    united = F.translate(strip_diacritics(F.translate(c, WORD_START + "﻿", " ")), VARIANTS + DROPPED[1:], UNITED)
    return F.trim(F.regexp_replace(united, r"(?U)\s+", " "))


def normalize_light(c: Column) -> Column:
    """Diacritics and tatweel dropped, letter variants united, white space joined; signs stay."""
    return F.trim(F.regexp_replace(F.translate(strip_diacritics(c), VARIANTS + "ـ", UNITED), r"(?U)\s+", " "))


def normalize_display(c: Column) -> Column:
    """Diacritics dropped and forms of alef united, nothing else."""
    return F.translate(strip_diacritics(c), "أإآٱ", "اااا")


def without_opening(norm: Column, surah: Column, ayah: Column) -> Column:
    """The text after its first opening formula is taken out, for first verses that are preceded by it; else null, as
    where nothing is left."""
    at = F.instr(norm, F.lit(OPENING))
    rest = F.when(at > 0, F.concat(F.substring(norm, F.lit(1), at - 1), F.substring(norm, at + len(OPENING), F.length(norm)))).otherwise(norm)
    return F.when((ayah == 1) & ~surah.isin(*WITHOUT_OPENING), F.nullif(F.trim(rest), F.lit("")))


def starts_with_opening(c: Column) -> Column:
    return normalize_display(c).startswith(OPENING)


def no_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def words(c: Column) -> Column:
    """Pieces between single spaces; an empty text has one empty piece."""
    return F.split(c, " ")


def trigrams(ns: Column) -> Column:
    """Distinct substrings of three characters in order of first occurrence; none of a shorter text."""
    return F.when(F.length(ns) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(ns) - 2), lambda i: F.substring(ns, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays have in common."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, n.cast("long")).otherwise(first - 1)


def rounded(c: Column, digits: int) -> Column:
    """Rounding half up, as floor(x * 10^n + 0.5) / 10^n."""
    return F.floor(c * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def preview(c: Column, n: int = 60) -> Column:
    return F.substring(c, 1, n)


def verse_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def key_part(key: Column, i: int) -> Column:
    """Part i (from 0) of a `surah:ayah` or `surah:ayah:word` key; null where it is missing or no number."""
    return F.try_element_at(F.split(key, ":"), F.lit(i + 1)).try_cast("int")


def arabic_number(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", ARABIC_DIGITS)


def display_words(c: Column) -> Column:
    """Words of a text in full writing; a piece of at most two pause marks belongs to the word before it."""
    joined = F.regexp_replace(c, f"(?<=\\S) (?=[{PAUSE_MARKS}]{{1,2}}(?: |$))", "\u0001")
    return F.transform(F.split(joined, " "), lambda w: F.translate(w, "\u0001", " "))


def trigger_label(c: Column) -> Column:
    return F.when(c == "surah_jump", "Surah jump").when(c == "rapid_switching", "Rapid switching").otherwise(c)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.7, "good").when(c >= 0.4, "warn").otherwise("error")


def relative_band(score: Column, top: Column) -> Column:
    """A score's band by its share of the top score; no band where the top is 0."""
    share = F.when(top > 0, score / top)
    return F.when(share >= 0.97, "top").when(share >= 0.85, "likely").otherwise("other")


def page_name(page: Column) -> Column:
    return F.lpad(page.cast("string"), 3, "0")
