"""Loading the four sheets into one table of phrase rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.rows import complete, count_label, situations, tier_counts, union_tiers
from ..operators.templates import expand
from .csv import read_sheet_strict

# The sheets' columns.
PHRASE = ("hindi", "marathi", "english", "roman", "situation", "note", "status", "source")
PATTERN = ("id", "hi_m", "hi_f", "hi_n", "mr_m", "mr_f", "mr_n", "en", "form", "takes", "note")
NOUN = ("hi", "mr", "en", "hi_gender", "mr_gender", "mr_oblique", "honorific", "category")


@dataclass
class Tiers:
    rows: DataFrame
    situations: DataFrame
    counts: DataFrame
    label: DataFrame


def load_tiers(spark: SparkSession, base: str) -> Tiers:
    """phrases.csv, patterns.csv, nouns.csv and corpus.csv under a folder; any of them may be missing."""
    sheet = lambda name, columns: read_sheet_strict(spark, f"{base}/{name}.csv", columns)
    phrases, corpus = (complete(sheet(n, PHRASE)).withColumnRenamed("ord", "idx") for n in ("phrases", "corpus"))
    rows = union_tiers(phrases, expand(sheet("patterns", PATTERN), sheet("nouns", NOUN)), corpus)
    counts = tier_counts(rows)
    return Tiers(rows, situations(rows), counts, count_label(counts))
