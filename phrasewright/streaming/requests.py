"""Search as a stream: of the requests of each session only the latest counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import batch_search

PAGE = 200
#: How long requests are gathered before they are answered.
GATHER = "40 milliseconds"
#: Distinct queries that one pass over the rows answers; more take more passes.
PASS = 64


def latest_requests(requests: DataFrame) -> DataFrame:
    """session, seq, q, situation of each session's request with the largest seq; aggregates with map-side combining."""
    return requests.groupBy("session").agg(F.max(F.struct("seq", "q", "situation")).alias("r")).select("session", "r.seq", "r.q", "r.situation")


def _passes(latest: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The distinct (situation, query) of some requests, a bounded number at a time."""
    asked = latest.select("situation", "q").distinct().orderBy("situation", "q").toLocalIterator()
    while own := [(r["situation"], r["q"]) for r in islice(asked, PASS)]:
        yield own


def answers(rows: DataFrame, requests: DataFrame, limit: int = PAGE) -> Iterator[DataFrame]:
    """session, seq, query, situation asked for and ranked results of each session's latest request, in as many frames as it takes: each
    answers up to PASS distinct queries in one pass over the rows.

    A request's situation filters before its head is taken. Blank queries are answered by search(), not here.
    """
    latest = latest_requests(requests).where("trim(coalesce(q, '')) <> ''").withColumn("situation", F.coalesce("situation", F.lit("")))
    for own in _passes(latest):
        out = None
        for situation, group in groupby(own, key=lambda x: x[0]):
            pool = rows.where(F.col("situation") == situation) if situation else rows
            part = batch_search(pool, [q for _, q in group], limit).withColumn("asked", F.lit(situation))
            out = part if out is None else out.unionByName(part)
        keys = latest.select("session", "seq", F.col("q").alias("query"), F.col("situation").alias("asked"))
        yield out.join(keys, ["query", "asked"])


def answer(rows: DataFrame, requests: DataFrame, limit: int = PAGE) -> DataFrame:
    """All frames of answers() as one, for requests of which the distinct queries are known to be few."""
    found = list(answers(rows, requests, limit))
    empty = requests.select("session", "seq", F.lit(None).cast("string").alias("query")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found) if found else empty


def search_stream(requests: DataFrame, rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, limit: int = PAGE, gather: str = GATHER) -> StreamingQuery:
    """Answer a stream of (session, seq, q, situation) requests. Those that come within `gather` are one micro-batch, of which only each
    session's latest counts; the sink gets its frames of answers one after another, with the batch's number."""

    def each(batch: DataFrame, n: int) -> None:
        kept = batch.persist()
        try:
            for found in answers(rows, kept, limit):
                sink(found, n)
        finally:
            kept.unpersist()

    return requests.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=gather).foreachBatch(each).start()
