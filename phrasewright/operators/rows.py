"""Phrase rows: filling in what is missing, search keys, tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_english, nfc, norm_dev, to_roman, words

COLUMNS = ("hindi", "marathi", "english", "roman", "situation", "note", "status", "source", "tier")
KEYS = ("dev", "rom", "en", "dev_words", "rom_words")
#: Room for so many rows in each tier when positions of several tiers are put one after another.
TIER_ROWS = 1 << 48


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan's rows, dealt by a key over all cores where they come in few pieces: a file of few row groups is a few tasks' work, however many rows
    it has."""
    pieces = 3 * scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(pieces, key) if scan.rdd.getNumPartitions() < pieces else scan


def complete(df: DataFrame) -> DataFrame:
    """df with every phrase column, missing and null ones empty, and other columns as they are."""
    given = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in COLUMNS}
    return df.withColumns(given)


def index_rows(df: DataFrame, compose: bool = True) -> DataFrame:
    """df (with idx) and its search keys: dev (2 fields), rom (3 fields), en, dev_words, rom_words.

    compose=False leaves out Unicode composition where the text is known to be composed.
    """
    df = complete(df)
    both = {c: nfc(F.col(c)) if compose else F.col(c) for c in ("hindi", "marathi")}
    d = df.withColumns({f"_{c}": e for c, e in both.items()})
    d = d.withColumns({
        "_d0": norm_dev(F.col("_hindi")), "_d1": norm_dev(F.col("_marathi")),
        "_r0": fold(F.when(F.col("roman") != "", F.col("roman")).otherwise(to_roman(F.col("_hindi")))), "_r1": fold(to_roman(F.col("_marathi"))), "en": fold_english(F.col("english")),
    })
    return d.select(
        *df.columns, F.array("_d0", "_d1").alias("dev"), F.array("_r0", "_r1", "en").alias("rom"), "en",
        words(F.col("_d0"), F.col("_d1")).alias("dev_words"), words(F.col("_r0"), F.col("_r1"), F.col("en")).alias("rom_words"),
    )


def strip(df: DataFrame) -> DataFrame:
    """Without the search keys."""
    return df.drop(*KEYS)


def union_tiers(curated: DataFrame, built: DataFrame, corpus: DataFrame) -> DataFrame:
    """All rows of three sheets (each with idx), tagged by tier, in the order curated, built, corpus.

    A corpus row's tier and status are overwritten, a curated row's tier. Positions of later tiers follow those of earlier ones.
    """
    parts = [complete(curated).withColumn("tier", F.lit("curated")), complete(built), complete(corpus).withColumns({"tier": F.lit("corpus"), "status": F.lit("corpus")})]
    moved = [p.withColumn("idx", F.col("idx").cast("long") + i * TIER_ROWS).select("idx", *COLUMNS) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, moved)


def tier_counts(rows: DataFrame) -> DataFrame:
    """One row: curated, built, corpus."""
    return rows.agg(*(F.coalesce(F.sum((F.col("tier") == t).cast("long")), F.lit(0)).alias(t) for t in ("curated", "built", "corpus")))


def count_label(counts: DataFrame) -> DataFrame:
    """One row: label, leaving out tiers without rows."""
    part = lambda c, text, always=False: F.when(F.lit(True) if always else F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    return counts.select(F.concat_ws(" + ", part("curated", " phrases", True), part("built", " built"), part("corpus", " from corpora")).alias("label"))


def situations(rows: DataFrame) -> DataFrame:
    """situation, first_idx: the non-empty situations of curated rows, to be shown in the order of first_idx."""
    return rows.where((F.col("tier") == "curated") & (F.col("situation") != "")).groupBy("situation").agg(F.min("idx").alias("first_idx"))
