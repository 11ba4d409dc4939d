"""Sentences from patterns and nouns that agree in gender and case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = "{X}"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _form(language: str, gender: Column) -> Column:
    """A pattern's form for a gender; where it is empty the neuter form, then the masculine."""
    m, f, n = (F.nullif(_text(f"{language}_{g}"), F.lit("")) for g in "mfn")
    own = F.when(F.lower(gender) == "m", m).when(F.lower(gender) == "f", f).otherwise(n)
    return F.coalesce(own, n, m, F.lit(""))


def _first(c: Column, what: Column, to: Column) -> Column:
    """c with the first `what` replaced, literally."""
    at = F.instr(c, what)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), to, F.substring(c, at + F.length(what), F.length(c)))).otherwise(c)


def expand(patterns: DataFrame, nouns: DataFrame) -> DataFrame:
    """Every valid pattern and noun as a phrase row of tier built.

    patterns: ord, id, hi_m..mr_n, en, form, takes, note; nouns: ord, hi, mr, en, hi_gender, mr_gender, mr_oblique, honorific,
    category. Joined on category; a pattern that names none takes all that there are. idx orders rows by pattern, then noun, with
    gaps where a pair is not valid.
    """
    takes = F.array_distinct(F.filter(F.transform(F.split(_text("takes"), "\\|"), lambda t: F.trim(t)), lambda t: t != ""))
    p = patterns.select("ord", "id", *(f"{x}_{g}" for x in ("hi", "mr") for g in "mfn"), F.col("en").alias("pattern_en"), "form", "note", takes.alias("takes"))
    every = nouns.agg(F.collect_set(_text("category"))).scalar()  # a handful of names, as one value
    named = p.withColumn("category", F.explode(F.when(F.size("takes") > 0, F.col("takes")).otherwise(every)))
    n = nouns.select(F.col("ord").alias("noun_ord"), "hi", "mr", "en", "hi_gender", "mr_gender", "mr_oblique", "honorific", _text("category").alias("category"))
    j = named.join(n, "category")
    hi, mr = _form("hi", _text("hi_gender")), _form("mr", _text("mr_gender"))
    stem = F.when(F.col("form").isin("oblique", "dative"), F.coalesce(F.nullif(_text("mr_oblique"), F.lit("")), F.col("mr"))).otherwise(F.col("mr"))
    j = j.withColumns({"_hi": hi, "_mr": mr, "_stem": F.coalesce(stem, F.lit(""))}).where("_hi <> '' and _mr <> ''")
    # an honorific noun takes the respectful dative
    polite = F.when((F.col("form") == "dative") & (_text("honorific") != ""), _first(F.col("_mr"), F.lit(SLOT + "ला"), F.lit(SLOT + "ना"))).otherwise(F.col("_mr"))
    return j.select(
        (F.col("ord").cast("long") * (1 << 32) + F.col("noun_ord")).alias("idx"),
        _first(F.col("_hi"), F.lit(SLOT), _text("hi")).alias("hindi"), _first(polite, F.lit(SLOT), F.col("_stem")).alias("marathi"),
        F.replace(_text("pattern_en"), F.lit(SLOT), _text("en")).alias("english"), F.lit("").alias("roman"), F.col("category").alias("situation"),
        _text("note").alias("note"), F.lit("built").alias("status"), _text("id").alias("source"), F.lit("built").alias("tier"),
    )
