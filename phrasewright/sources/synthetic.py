"""A growing vocabulary of made-up nouns from a seeded generator, for benchmarks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The letters and signs that nouns are made of, and the generator's constants.
LETTERS = "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"
SIGNS = ["", *"ािीुूेैोौ"]
MULTIPLIER, INCREMENT, MASK = 1103515245, 12345, 0x7FFFFFFF


class Draws:
    """The generator: products are taken in double precision before they are masked."""

    def __init__(self, seed: int = 7):
        self.seed = seed

    def __call__(self, n: int) -> int:
        self.seed = int(float(self.seed) * float(MULTIPLIER) + float(INCREMENT)) & MASK
        return self.seed % n


def made_up_nouns(first: int, until: int, categories: list[str], draw: Draws) -> Iterator[tuple]:
    """(ord, hi, mr, en, hi_gender, mr_gender, mr_oblique, honorific, category); the number of syllables is drawn anew before each."""
    for n in range(first, until):
        w, i = "", 0
        while i < 2 + draw(2):
            w += LETTERS[draw(len(LETTERS))] + SIGNS[draw(len(SIGNS))]
            i += 1
        yield n, w, w, f"thing{n}", "mfn"[draw(3)], "mfn"[draw(3)], w, "", categories[draw(len(categories))]


def noun_table(spark: SparkSession, first: int, until: int, categories: list[str], draw: Draws) -> DataFrame:
    schema = "ord int, hi string, mr string, en string, hi_gender string, mr_gender string, mr_oblique string, honorific string, category string"
    return spark.createDataFrame(list(made_up_nouns(first, until, categories, draw)), schema)


def categories(nouns: DataFrame) -> DataFrame:
    """category, first: the nouns' categories, to be taken in the order of first."""
    return nouns.groupBy("category").agg(F.min("ord").alias("first"))


def corpus_of(base: DataFrame, patterns: DataFrame, nouns: DataFrame, n_nouns: int, draw: Draws) -> DataFrame:
    """base (phrase rows with idx) and every sentence of the patterns with the nouns, grown to n_nouns by made-up ones.

    Categories are drawn from those the nouns have, in the order they are first seen. The draws go on from the generator's state.
    """
    from ..operators.rows import TIER_ROWS, complete
    from ..operators.templates import expand

    have = nouns.count()
    seen = categories(nouns).orderBy("first").collect()  # a handful
    more = noun_table(base.sparkSession, have, n_nouns, [r["category"] for r in seen], draw) if n_nouns > have else nouns.limit(0)
    last = nouns.agg({"ord": "max"}).first()[0]
    more = more.withColumn("ord", (more["ord"] - have + (0 if last is None else last + 1)).cast(nouns.schema["ord"].dataType))  # after all given ones
    grown = expand(patterns, nouns.unionByName(more.select(*nouns.columns)))
    built = grown.withColumn("idx", grown["idx"] + 3 * TIER_ROWS)
    columns = complete(base).columns
    return complete(base).unionByName(complete(built).select(*columns))
