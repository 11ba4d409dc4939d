"""Normalisers of phrases as Column expressions: roman spelling, phonetic folding, Devanagari clean-up.

All of them are native expressions. Unicode composition (NFC), for which Spark has no function, is applied once at ingest
by nfc(); everything here expects composed text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import ship

# The white space of the query language, as one explicit class for every engine.
SPACES = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_CLASS = f"[{SPACES}]"

# Consonants, independent vowels and vowel signs with their roman spelling.
CONSONANTS = dict(zip(
    "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवळशषसह",
    ["k", "kh", "g", "gh", "n", "ch", "chh", "j", "jh", "n", "t", "th", "d", "dh", "n", "t", "th", "d", "dh", "n", "p", "ph", "b", "bh", "m", "y", "r", "l", "v", "l", "sh", "sh", "s", "h"],
    strict=True,
))
VOWELS = dict(zip("अआइईउऊऋएऐओऔ", ["a", "aa", "i", "ee", "u", "oo", "ri", "e", "ai", "o", "au"], strict=True))
SIGNS = dict(zip("ािीुूृेैोौ", ["aa", "i", "ee", "u", "oo", "ri", "e", "ai", "o", "au"], strict=True))
NASALS, VISARGA, HALANT = "ंँ", "ः", "्"

# Marks and joiners, then punctuation, that clean-up drops.
DROPPED_MARKS = "\u093c\u200b\u200c\u200d\ufeff"
DROPPED_POINTS = "?।!,.'\"()‘’“”"

# Rewrites of the phonetic fold, in order.
FOLDS = [("aa+", "a"), ("ee+", "i"), ("ii+", "i"), ("oo+", "u"), ("uu+", "u"), ("ph", "f"), ("w", "v"), ("z", "j"), ("chh", "ch"), ("ck", "k")]

# English function words that carry no signal in a query of several words.
STOP_WORDS = (
    "a an the i im me my you your he she it we they is am are was be do does did to of in on at for and or this that have has can will would please some any"
).split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every letter the roman spelling knows, and a code of one letter for it; codes of several letters are spelled out after.
LETTERS = {**CONSONANTS, **VOWELS, **SIGNS, **dict.fromkeys(NASALS, "n"), VISARGA: "h"}
CODES = {s: chr(0xE000 + i) for i, s in enumerate(sorted({v for v in LETTERS.values() if len(v) > 1}))}


def _ranges(chars: str) -> str:
    """The characters as the inside of a class, neighbours as a range: a class is asked part by part."""
    out, points = [], sorted(set(map(ord, chars)))
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


#: The classes that Column forms use.
_SPACES, _CONSONANTS, _SIGNS, _LETTERS = (_ranges("".join(x)) for x in (SPACES, CONSONANTS, [*SIGNS, HALANT], LETTERS))
#: Folds without those that shorten a run to its own letter, which the last step does for all letters and none of the others hinges on.
_FOLDS = [(pattern, to) for pattern, to in FOLDS if pattern != f"{to}{to}+"]


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    """Only texts that are not composed already are touched; a batch of plain ASCII is passed on whole."""
    if pc.all(pc.string_is_ascii(pa.array(s, pa.string(), from_pandas=True))).as_py() is not False:
        return s
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def nfc(c: Column | str) -> Column:
    """Unicode composition; null stays null."""
    ship(SparkSession.active())
    return _composed(c)


def trim_js(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE_CLASS}+", ""), f"{SPACE_CLASS}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{_SPACES}]+", " "))


def is_devanagari(c: Column) -> Column:
    return c.rlike("[ऀ-ॿ]")


def fold(c: Column) -> Column:
    """The phonetic skeleton of roman text: spelling variants of one word come out alike."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^a-z{_SPACES}]", "")
    for pattern, to in _FOLDS:
        c = F.regexp_replace(c, pattern, to) if "+" in pattern else F.replace(c, F.lit(pattern), F.lit(to))
    return squeeze(F.regexp_replace(c, r"([a-z])\1+", "$1"))


def fold_english(c: Column) -> Column:
    """fold(), with slashes and brackets as spaces."""
    return fold(F.translate(F.coalesce(c, F.lit("")), "/()", "   "))


def to_roman(c: Column) -> Column:
    """A rough roman spelling of Devanagari. A consonant without a vowel sign or halant is followed by a."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(c, f"([{_CONSONANTS}])(?![{_SIGNS}])", "$1a")
    c = F.regexp_replace(c, f"[{_SPACES}]", " ")
    c = F.regexp_replace(c, f"[^a-zA-Z0-9 {_LETTERS}]", "")
    c = F.translate(c, UPPER + "".join(LETTERS), LOWER + "".join(CODES.get(v, v) for v in LETTERS.values()))
    for spelled, code in CODES.items():
        c = F.replace(c, F.lit(code), F.lit(spelled))
    return F.trim(F.regexp_replace(c, " +", " "))


def norm_dev(c: Column) -> Column:
    """Devanagari without nukta, joiners and punctuation; lower case, single spaces."""
    return F.trim(F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), DROPPED_MARKS + DROPPED_POINTS, ""), f"[{_SPACES}]+", " ")))


def js_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(c) + F.regexp_count(c, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def escape_html(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for x, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(x), F.lit(to))
    return c


def ngrams(c: Column, n: int) -> Column:
    """Distinct substrings of n characters, in order of appearance; none in shorter strings."""
    found = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(c) >= n, found).otherwise(F.array().cast("array<string>")))


def words(*fields: Column) -> Column:
    """Distinct non-empty words of all fields, in order of appearance."""
    return F.filter(F.array_distinct(F.flatten(F.array(*(F.split(f, " ") for f in fields)))), lambda w: w != "")
