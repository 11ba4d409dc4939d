"""What indexed search leaves out, query by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import js_length
from .search import PhraseIndex

REPORT = "query string, found long, missed long, extra long, deepest long, page_same boolean"


def result_key() -> Column:
    """What tells results apart for a reader: both texts."""
    return F.concat_ws("|", "hindi", "marathi")


def except_keys(one: DataFrame, two: DataFrame) -> DataFrame:
    """The results of one search whose texts another one does not have, as often as they occur."""
    return one.withColumn("key", result_key()).join(two.select(result_key().alias("key")), "key", "left_anti")


def _placed(found: DataFrame) -> DataFrame:
    """idx and what results are ranked by, smallest first."""
    return found.select("idx", F.struct((-F.col("score")).alias("score"), F.expr(js_length("hindi")).alias("length"), F.col("idx").alias("at")).alias("place"))


def parity(index: PhraseIndex, queries: list[str], page: int = 200, situation: str | None = None) -> DataFrame:
    """One row for each query: found (exhaustive), missed, extra, deepest (the largest rank missed, 0 if none is) and page_same (the first `page`
    results agree).

    Rows are told apart by idx. Each query is two searches, one outer join on idx, and a count of what ranks before the last row
    missed; no list is ranked as a whole. Two pages of idx and a row of counts for each query come to the driver.
    """
    out = []
    for text in queries:
        full, part = (index.search(text, situation, exhaustive=e) for e in (True, False))
        one, two = _placed(full), _placed(part).withColumnRenamed("place", "other")
        both = one.join(two, "idx", "full_outer")
        n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        r = both.agg(n(F.col("place").isNotNull()).alias("found"), n(F.col("other").isNull()).alias("missed"), n(F.col("place").isNull()).alias("extra"), F.max(F.when(F.col("other").isNull(), F.col("place"))).alias("last")).first()
        deepest = 0
        if r["last"] is not None:
            deepest = one.where(F.col("place") <= F.struct(*(F.lit(x).alias(c) for c, x in r["last"].asDict().items()))).count()
        pages = [[x["idx"] for x in index.search(text, situation, page, exhaustive=e).select("idx").collect()] for e in (True, False)]
        out.append((text, r["found"], r["missed"], r["extra"], deepest, pages[0] == pages[1]))
    return index.rows.sparkSession.createDataFrame(out, REPORT)


def head_agrees(index: PhraseIndex, queries: list[str], limit: int, exhaustive: bool = False) -> DataFrame:
    """query, rank, idx, whole: the first rows that a limited search gives, and the rank at which the unlimited one, of which as many are looked
    at, has the same row (null if it has not). Both lists are `limit` rows long at most."""
    out = []
    for text in queries:
        short, long = ([r["idx"] for r in index.search(text, limit=n, exhaustive=exhaustive).select("idx").take(limit)] for n in (limit, None))
        out += [(text, k, idx, long.index(idx) + 1 if idx in long else None) for k, idx in enumerate(short, 1)]
    return index.rows.sparkSession.createDataFrame(out, "query string, rank long, idx long, whole long")
