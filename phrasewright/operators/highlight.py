"""Marking the words of a text that a query landed on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.query_text import fold, norm_dev, parse_query
from ..functions.score import word_hit
from ..functions.text import SPACES, escape_html, to_roman
from ..functions.text import fold as fold_column
from ..functions.text import norm_dev as norm_column


def highlight(df: DataFrame, column: str, query: str | None, to: str) -> DataFrame:
    """df with a column `to`: HTML of a (composed) text column, its matching words marked and white space as it was.

    Stop words mark too. A null text is empty.
    """
    parsed = parse_query(query)
    tokens = [t for t in (norm_dev(parsed.raw) if parsed.devanagari else fold(parsed.raw)).split(" ") if t]
    if not tokens:
        return df.withColumn(to, escape_html(F.col(column)))
    edge = f"(?<=[{SPACES}])(?=[^{SPACES}])|(?<=[^{SPACES}])(?=[{SPACES}])"
    key = norm_column if parsed.devanagari else lambda piece: fold_column(to_roman(piece))
    pieces = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), edge), lambda p: F.struct(key(p).alias("key"), escape_html(p).alias("shown")))
    hit = " OR ".join(word_hit("x.key", t) for t in tokens)
    marked = F.expr(f"array_join(transform(_pieces, x -> if({hit}, concat('<mark>', x.shown, '</mark>'), x.shown)), '')")
    return df.withColumn("_pieces", pieces).withColumn(to, marked).drop("_pieces")
