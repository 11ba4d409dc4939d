"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each text is measured by built-in expressions, row by row. The measures of each (language, source) go into a quantile
sketch: a count for each bin, bins having a bounded relative width (values below 256 are exact, larger ones keep their
8 leading bits). Sketches are merged by adding counts, so they are built with map-side combining, a hot source is no
more work for one task than a rare one, and the sketches of a language or of everything are sums of those of its groups.
Fences come from the sketch's quantiles instead of fixed cutoffs, and are joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialise, tasks_for

SPACE = r"[ \\t\\n\\x0B\\f\\r]"  # inside a SQL string literal
#: Below so many texts a group's sketch is not trusted unless a caller says otherwise; that of its language, then that of all texts takes its place.
LEAST_TEXTS = 50
#: measure -> (spreads above the median, slack above, spreads below, slack below); None: no fence on that side. A spread is
#: the median's distance to the 10th or 90th percentile on the side away from the fence, where junk does not reach. Rates, of which many texts
#: have none, have no such side: for those of RATES the distance up to the 75th percentile counts where it is larger, so that a source in which
#: such texts are common has a wide fence, and junk of less than a quarter of a source does not widen it.
FENCES = {
    "word_length": (6, 300, 6, 200),  # hundredths of a character a word
    "symbol_rate": (3, 100, None, None),  # symbols in 1000 words
    "dup_line_rate": (3, 400, None, None),  # repeated lines in 1000 lines
}
RATES = ("symbol_rate", "dup_line_rate")


def measures(df: DataFrame, text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """row (df's columns, as they are), the groups g0, g1, ... and a struct q of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and the measures of FENCES. df's names stay inside row, so none of them can meet a helper's."""
    e = F.expr
    groups = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)]
    d = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *groups, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("w", e(f"filter(split(t, '{SPACE}+'), w -> w <> '')"))
    d = d.withColumn("lines", e(f"filter(split(t, '\\n', -1), x -> x rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')"))
    d = d.withColumn("h", e("transform(w, w -> xxhash64(w))"))
    d = d.withColumn("g", e("if(size(h) < 5, cast(array() as array<bigint>), transform(slice(h, 1, size(h) - 4), (x, i) -> xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4])))"))
    d = d.withColumn("again", e("size(array_distinct(g)) < size(g)"))
    # only texts that repeat a window sort (hash, place) pairs, to find the places; a place counts up to the next one
    d = d.withColumn("s", e("if(again, sort_array(transform(g, (x, i) -> struct(x as g, i as p))), cast(null as array<struct<g:bigint,p:int>>))"))
    d = d.withColumn("p", e("sort_array(filter(transform(s, (x, i) -> if((i > 0 and x.g = get(s, i - 1).g) or (i + 1 < size(s) and x.g = get(s, i + 1).g), x.p, -1)), p -> p >= 0))"))
    d = d.withColumn("r", e("cast(coalesce(aggregate(transform(p, (x, i) -> least(5, coalesce(get(p, i + 1), x + 5) - x)), 0, (a, x) -> a + x), 0) as bigint)"))
    d = d.withColumn("n", F.size("w").cast("long")).withColumn("c", F.length(F.array_join("w", "")).cast("long")).withColumn("y", F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("nl", F.size("lines").cast("long")).withColumn("d", F.col("nl") - F.size(F.array_distinct("lines")))
    ratio = lambda k, x, n: F.when(F.col(n) > 0, F.floor(F.lit(k) * F.col(x) / F.col(n))).otherwise(F.lit(0)).cast("long")
    q = F.struct(
        F.col("n").alias("n_words"), F.col("c").alias("word_chars"), F.col("y").alias("n_symbols"), F.col("d").alias("n_dup_lines"), F.col("r").alias("n_repeat_words"),
        e("n < 10 or 100 * r > 20 * n").alias("base_failed"),
        ratio(100, "c", "n").alias("word_length"), ratio(1000, "y", "n").alias("symbol_rate"), ratio(1000, "d", "nl").alias("dup_line_rate"),
    )
    return d.select("row", *(f"g{i}" for i in range(len(by))), q.alias("q"))


def fences(measured: DataFrame, levels: int, least: int, short: int) -> DataFrame:
    """low_* and high_* of each measure for each group g0, g1, ... (nulls are a group), from the texts that pass the base rules."""
    groups = [f"g{i}" for i in range(levels)]
    per = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(f"q.{m}").alias("v")) for m in FENCES)))
    spare = "cast(greatest(0, length(bin(x.v)) - 8) as int)"
    bins = measured.where("not q.base_failed").select(*groups, per.alias("x"))
    bins = bins.select(*groups, F.col("x.m").alias("m"), F.expr(f"shiftleft(shiftright(x.v, {spare}), {spare})").alias("bin"))
    bins = materialise(bins.groupBy(*groups, "m", "bin").agg(F.count(F.lit(1)).alias("n")), "sketches", short)

    def level(keys: list[str]) -> DataFrame:
        """Quantiles of the sketches merged by some of the keys."""
        merged = bins.groupBy(*keys, "m", "bin").agg(F.sum("n").alias("n"))
        up_to = merged.groupBy(*keys, "m").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("s"), F.sum("n").alias("total"))
        at = lambda q: F.expr(f"aggregate(s, named_struct('c', 0L, 'v', cast(null as bigint)), (a, x) -> named_struct('c', a.c + x.n, 'v', if(a.v is null and 100 * (a.c + x.n) >= {q} * total, x.bin, a.v))).v")
        return up_to.select(*keys, "m", "total", *(at(q).alias(f"q{q}") for q in (10, 50, 75, 90)))

    found = measured.select(*groups).distinct()
    out = found.select("*", F.explode(F.array(*map(F.lit, FENCES))).alias("m"))
    for k in range(levels, -1, -1):
        keys = groups[:k]
        own = level(keys).select(*(F.col(c).alias(f"k{c}") for c in keys), F.col("m").alias("km"), F.struct("total", "q10", "q50", "q75", "q90").alias(f"l{k}"))
        on = F.col("m") == F.col("km")
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"k{c}"))
        out = out.join(own, on, "left").drop("km", *(f"k{c}" for c in keys))
    trusted = [F.when(F.col(f"l{k}.total") >= least, F.col(f"l{k}")) for k in range(levels, 0, -1)]
    out = out.select(*groups, "m", F.coalesce(*trusted, F.col("l0")).alias("s"))
    high, low = F.lit(None).cast("long"), F.lit(None).cast("long")
    for m, (a, b, c, d) in FENCES.items():
        spread = F.col("s.q50") - F.col("s.q10")
        spread = F.greatest(spread, F.col("s.q75") - F.col("s.q50")) if m in RATES else spread
        high = F.when(F.col("m") == m, F.col("s.q50") + a * spread + b).otherwise(high)
        if c is not None:
            low = F.when(F.col("m") == m, F.col("s.q50") - c * (F.col("s.q90") - F.col("s.q50")) - d).otherwise(low)
    out = out.select(*groups, "m", high.alias("high"), low.alias("low"))
    return out.groupBy(*groups).agg(*(F.max(F.when(F.col("m") == m, F.col(x))).alias(f"{x}_{m}") for m in FENCES for x in ("low", "high")))


def judge(measured: DataFrame, levels: int, least: int, short: int) -> DataFrame:
    """measured (a written table: it is read twice) with kept: base rules passed and every measure within its group's fences.

    Null language or source is a group of its own. A group none of whose texts pass the base rules, or with fewer than
    `least` that do, uses its language's fences, then those of all texts. Repeated rows are judged alike.
    """
    limits = fences(measured, levels, least, short).select(*(F.col(f"g{i}").alias(f"f{i}") for i in range(levels)), *(f"{x}_{m}" for m in FENCES for x in ("low", "high")))
    limits = materialise(limits, "fences", short)  # a row for each group; where they are few, rows stay where they are
    on = F.lit(True)
    for i in range(levels):
        on = on & F.col(f"g{i}").eqNullSafe(F.col(f"f{i}"))
    inside = F.lit(True)
    for m, (_, _, lower, _) in FENCES.items():
        inside = inside & F.coalesce(F.col(f"q.{m}") <= F.col(f"high_{m}"), F.lit(True))
        if lower is not None:
            inside = inside & F.coalesce(F.col(f"q.{m}") >= F.col(f"low_{m}"), F.lit(True))
    return measured.join(F.broadcast(limits) if few(limits) else limits, on, "left").select("row", "q", (~F.col("q.base_failed") & inside).alias("kept"))


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), least: int = LEAST_TEXTS) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row. Null text has no words and fails; no rows give no rows."""
    tasks = tasks_for(df)
    small = measures(df, text_col, by).select(F.struct(F.col(f"row.`{id_col}`").alias("doc_id")).alias("row"), *(f"g{i}" for i in range(len(by))), "q")
    return judge(materialise(small, "measures", tasks), len(by), least, tasks_for(df, True)).select("row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "kept")


def keep_good(df: DataFrame, text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), least: int = LEAST_TEXTS) -> DataFrame:
    """The rows of df that pass, as they are; its columns may have any names. Null text fails; no rows give no rows."""
    tasks = tasks_for(df)
    return judge(materialise(measures(df, text_col, by), "measured", tasks), len(by), least, tasks_for(df, True)).where("kept").select("row.*").coalesce(tasks)
