"""Scores of words and rows against query tokens, as SQL expressions over an indexed row.

Expressions are written as SQL text: a query is one parse for Spark, not a call for every operator. Arguments named `w`,
`side` and so on are SQL expressions; tokens are literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .query_text import Query, ngrams

# The least bigram similarity that counts, what each rule scores (a word that is the token, begins with it, shares its
# stem; a field that is the token, begins with it, holds it; a fuzzy word scores 1 and its similarity), tier and status weights.
FUZZY = 0.55
SAME_WORD, WORD_BEGINS, SAME_STEM = 4.5, 3.5, 2.5
SAME_FIELD, FIELD_BEGINS, FIELD_HOLDS = 5.0, 4.0, 3.0
WEIGHTS = (("tier", "built", 0.92), ("tier", "corpus", 0.8), ("status", "ok", 1.08))
#: The search sides of an indexed row, and their number of fields.
SIDES = {"dev": 2, "rom": 3}


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def js_length(e: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({e}) + regexp_count({e}, '[\\\\x{{10000}}-\\\\x{{10FFFF}}]'))"


def dice(w: str, token: str) -> str:
    """Bigram similarity of a word and a token; 0 for words under three characters and tokens under two bigrams."""
    own = ngrams(token, 2)
    if len(own) < 2:
        return "0D"
    shared = " + ".join(f"if(contains({w}, {quoted(g)}), 1, 0)" for g in own)  # so a word's own bigrams are only counted where it shares one
    theirs = f"size(array_distinct(transform(sequence(1, length({w}) - 1), i -> substring({w}, i, 2))))"
    return f"(CASE WHEN length({w}) < 3 OR ({shared}) = 0 THEN 0D ELSE 2D * ({shared}) / ({theirs} + {len(own)}) END)"


def stem_length(token: str) -> int:
    """How many leading characters a word must share with a token to count as the same stem."""
    return max(3, next(k for k in range(len(token) + 1) if k >= len(token) * 0.7))


def stem(w: str, token: str) -> str:
    k = stem_length(token)
    return "false" if len(token) < k else f"startswith({w}, {quoted(token[:k])})"


def word_score(w: str, token: str) -> str:
    t, d = quoted(token), dice(w, token)
    return f"CASE WHEN {w} = {t} THEN {SAME_WORD}D WHEN startswith({w}, {t}) THEN {WORD_BEGINS}D WHEN {stem(w, token)} THEN {SAME_STEM}D WHEN {d} >= {FUZZY}D THEN 1D + {d} ELSE 0D END"


def word_hit(w: str, token: str) -> str:
    """Whether a token is a reason to mark a word."""
    t = quoted(token)
    inside = f" OR contains({w}, {t})" if len(token) > 3 else ""
    return f"({w} <> '' AND (startswith({w}, {t}){inside} OR {stem(w, token)} OR {dice(w, token)} >= {FUZZY}D))"


def token_score(token: str, side: str) -> Column:
    """The best rule that joins a token to one side of a row; 0 if none does. Words are looked at only where no field is the token."""
    t = quoted(token)
    fields = ", ".join(f"CASE WHEN startswith({side}[{i}], {t}) THEN {FIELD_BEGINS}D WHEN contains({side}[{i}], {t}) THEN {FIELD_HOLDS}D ELSE 0D END" for i in range(SIDES[side]))
    return F.expr(f"CASE WHEN array_contains({side}, {t}) THEN {SAME_FIELD}D ELSE greatest({fields}, coalesce(array_max(transform({side}_words, w -> {word_score('w', token)})), 0D)) END")


def row_score(query: Query, scores: list[str], side: str) -> Column:
    """Mean token score, plus how much of the first field was typed, plus a bonus for the whole phrase, times the weights."""
    score = f"({' + '.join(scores)}) / {len(scores)}D + least(1D, {query.typed}D / greatest(1, {js_length(f'{side}[0]')}))"
    if query.several:
        p = quoted(query.phrase)
        score += " + CASE " + " ".join(f"WHEN {side}[{i}] = {p} THEN 4D WHEN contains({side}[{i}], {p}) THEN 2D" for i in range(SIDES[side])) + " ELSE 0D END"
    weights = " ".join(f"* if({name} = '{value}', {weight}D, 1D)" for name, value, weight in WEIGHTS)
    return F.expr(f"({score}) {weights}")
