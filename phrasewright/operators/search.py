"""Ranked search over indexed rows: exhaustive, through a trigram index, and for many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query_text import Query, ngrams, parse_query
from ..functions.score import SIDES, js_length, quoted, row_score, token_score, word_score
from ..functions.text import ngrams as gram_column
from .rows import KEYS, strip

GRAM, PROBES = 3, 3


def _side(query: Query) -> str:
    return "dev" if query.devanagari else "rom"


def scored(rows: DataFrame, query: Query) -> DataFrame:
    """The rows that every token of a query matches, with their score.

    A token's score is generated: a filter is not pushed below a generator, so that the score, and the keys under it where they are not stored,
    are computed once for a row and not once for each place in the filter that names them.
    """
    side = _side(query)
    names = [f"_s{i}" for i in range(len(query.tokens))]
    d = rows
    for name, token in zip(names, query.tokens, strict=True):
        d = d.select("*", F.explode(F.array(token_score(token, side))).alias(name)).where(F.col(name) > 0)  # a row that fails one token is not scored for the next
    return d.withColumn("score", row_score(query, names, side)).drop(*names)


def order() -> list[Column]:
    """The total order of results: score, then the shorter phrase, then position."""
    return [F.desc("score"), F.expr(js_length("hindi")), F.col("idx")]


def search(rows: DataFrame, text: str | None, situation: str | None = None, limit: int | None = None, few: bool = False) -> DataFrame:
    """The ranked rows for a query, without search keys, score added; exhaustive.

    A blank query gives all rows in the order of idx, score null; a query of which nothing is left after normalising gives
    none. With a limit, exactly the head of the full ranking. few: a caller knows that not many rows can match, so that one task orders
    them, without sampling their ranges first.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    query = parse_query(text)
    if situation:
        rows = rows.where(F.col("situation") == situation)
    if query.blank:
        out = strip(rows).withColumn("score", F.lit(None).cast("double")).orderBy("idx")
    elif not query.tokens:
        out = strip(rows).withColumn("score", F.lit(None).cast("double")).where(F.lit(False))
    else:
        found = strip(scored(rows, query))
        if limit is None:  # ranges are sampled from what was exchanged, which does not score every row a second time
            found = found.repartition(1) if few else found.repartition("idx")
        out = found.sortWithinPartitions(*order()) if few and limit is None else found.orderBy(*order())
    return out if limit is None else out.limit(limit)


def ranked(results: DataFrame) -> DataFrame:
    """Results with their rank from 1; for result lists, which a limit bounds."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*order())))


def postings(rows: DataFrame) -> DataFrame:
    """side, gram, idx: the distinct trigrams of each row's fields. No gram spans two fields."""
    grams = lambda side, n: F.array_distinct(F.flatten(F.array(*(gram_column(F.get(F.col(side), F.lit(i)), GRAM) for i in range(n)))))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), grams(s, n).alias("grams")) for s, n in SIDES.items())))
    return rows.select("idx", each.alias("x")).select("idx", F.col("x.side").alias("side"), F.explode("x.grams").alias("gram")).select("side", "gram", "idx")


def word_postings(rows: DataFrame) -> DataFrame:
    """side, word, idx: the distinct words of each row's fields."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_words").alias("words")) for s in SIDES)))
    return rows.select("idx", each.alias("x")).select("idx", F.col("x.side").alias("side"), F.explode("x.words").alias("word")).select("side", "word", "idx")


def word_counts(found: DataFrame) -> DataFrame:
    """side, word, df: the vocabulary, and how many rows hold each word."""
    return found.groupBy("side", "word").agg(F.count(F.lit(1)).alias("df"))


def gram_counts(found: DataFrame) -> DataFrame:
    """side, gram, df: how many rows hold each gram."""
    return found.groupBy("side", "gram").agg(F.count(F.lit(1)).alias("df"))


def total_postings(counts: DataFrame) -> DataFrame:
    """side, grams, postings: the size of an index."""
    return counts.groupBy("side").agg(F.count(F.lit(1)).alias("grams"), F.sum("df").alias("postings"))


#: Grams whose counts an index keeps on the driver at most (trigrams of two alphabets; a few dozen bytes each).
MOST_GRAMS = 1 << 18
#: Candidates that are taken from the postings at most, and the part of all rows below which that beats looking at the rows themselves.
MOST_CANDIDATES, SELECTIVE = 200_000, 0.05
#: Rows that are sooner asked for a few grams than a job on the postings begins.
LEAST_ROWS = 500_000
#: Results up to which one task orders them: ranges for several would be sampled first, which scores every row twice.
MOST_SORTED = 1_000_000
#: Words that a text's tokens match, fuzzily too, up to which rows are asked for them one by one.
MOST_WORDS = 2000


@dataclass
class PhraseIndex:
    """Indexed rows, their trigram postings with gram counts, and their word postings with the vocabulary. Written by save(), postings
    sorted by side and key, so that a probe reads only the row groups that hold its grams or words."""

    rows: DataFrame
    postings: DataFrame
    counts: DataFrame
    words: DataFrame
    vocabulary: DataFrame
    _df: dict[tuple[str, str], int] = field(default_factory=dict, repr=False)
    _whole: bool | None = field(default=None, repr=False)
    _n: int | None = field(default=None, repr=False)

    @classmethod
    def build(cls, rows: DataFrame) -> PhraseIndex:
        found, words = postings(rows), word_postings(rows)
        return cls(rows, found, gram_counts(found), words, word_counts(words))

    def save(self, path: str) -> PhraseIndex:
        spark = self.rows.sparkSession
        self.rows.write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")

        def write(table: DataFrame, name: str, key: str, count: Callable[[DataFrame], DataFrame], counted: str) -> None:
            # by idx as well, so that a key which many rows hold is not one task's work
            table.repartitionByRange("side", key, "idx").sortWithinPartitions("side", key).write.parquet(f"{path}/{name}")
            count(spark.read.parquet(f"{path}/{name}")).write.parquet(f"{path}/{counted}")

        # the two kinds of postings have nothing to do with each other, so that one's small jobs fill the gaps of the other's
        with ThreadPoolExecutor(2) as pool:
            for done in [pool.submit(write, postings(rows), "postings", "gram", gram_counts, "counts"), pool.submit(write, word_postings(rows), "words", "word", word_counts, "vocabulary")]:
                done.result()
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PhraseIndex:
        return cls(*(spark.read.parquet(f"{path}/{part}") for part in ("rows", "postings", "counts", "words", "vocabulary")))

    @property
    def size(self) -> int:
        """How many rows there are; counted once."""
        if self._n is None:
            self._n = self.rows.count()
        return self._n

    def gram_df(self, side: str, grams: list[str]) -> dict[str, int]:
        """The grams that some row holds, and how many rows do. All counts are read at the first question if they are few enough, else only
        those asked for; either way no gram is looked up twice."""
        if self._whole is None:
            found = self.counts.limit(MOST_GRAMS + 1).collect()  # bounded
            self._whole = len(found) <= MOST_GRAMS
            if self._whole:
                self._df = {(r["side"], r["gram"]): r["df"] for r in found}
        missing = [] if self._whole else [g for g in grams if (side, g) not in self._df]
        if missing:
            found = {r["gram"]: r["df"] for r in self.counts.where((F.col("side") == side) & F.col("gram").isin(missing)).collect()}  # at most as many as are asked for
            self._df |= {(side, g): found.get(g, 0) for g in missing}
        return {g: n for g in grams if (n := self._df.get((side, g), 0))}

    def probes(self, query: Query) -> list[list[str]] | None:
        """For each token of three characters or more, its first known gram and the two rarest others; None if no token has three."""
        use = [t for t in query.tokens if len(t) >= GRAM]
        if not use:
            return None
        known = self.gram_df(_side(query), sorted({g for t in use for g in ngrams(t, GRAM)}))
        out = []
        for t in use:
            own = [g for g in ngrams(t, GRAM) if g in known]
            out.append(own[:1] + sorted(own[1:], key=lambda g: known[g])[: PROBES - 1])
        return out

    def at_most(self, query: Query, probes: list[list[str]]) -> int:
        """More candidates than this there are not: those of the token whose grams are rarest."""
        known = self.gram_df(_side(query), sorted({g for p in probes for g in p}))
        return min(sum(known[g] for g in p) for p in probes)

    def candidates(self, query: Query) -> DataFrame | None:
        """idx of the rows met under every token; None if the index has nothing to go by."""
        probes = self.probes(query)
        if probes is None:
            return None
        wanted = sorted({g for p in probes for g in p})
        hit = self.postings.where((F.col("side") == _side(query)) & F.col("gram").isin(wanted) if all(probes) else F.lit(False))
        met = [F.max(F.col("gram").isin(p)) if p else F.lit(False) for p in probes]
        return hit.groupBy("idx").agg(reduce(lambda a, b: a & b, met).alias("all")).where("all").select("idx")

    def _pays(self, most: int) -> bool:
        """Whether so many candidates at most are better taken from postings than from the rows."""
        return self.size > LEAST_ROWS and most <= min(MOST_CANDIDATES, SELECTIVE * self.size)

    def _pool(self, query: Query) -> tuple[DataFrame, bool]:
        """The rows met under every token, and whether they are few. Few are taken from the postings and sent to the rows; of many, the rows
        themselves are asked for the same grams, which needs no exchange."""
        probes = self.probes(query)
        if probes is None:
            return self.rows, self.size <= MOST_SORTED
        if not all(probes):
            return self.rows.where(F.lit(False)), True
        most = self.at_most(query, probes)
        if self._pays(most):
            return self.rows.join(F.broadcast(self.candidates(query)), "idx", "left_semi"), True
        side = _side(query)
        held = [" OR ".join(f"contains({side}[{i}], {quoted(g)})" for g in p for i in range(SIDES[side])) for p in probes]
        return self.rows.where(F.expr(" AND ".join(f"({h})" for h in held))), most <= MOST_SORTED

    def _complete_pool(self, query: Query) -> tuple[DataFrame, bool]:
        """The rows that can score. All rules of a row hold through one of its words, so distinct words are tried, fuzzy ones included. Where
        they are few, rows are taken from their postings if that leaves few rows, else asked for these words; where not, all rows stay."""
        side, tokens = _side(query), range(len(query.tokens))
        hit = {f"hit{i}": F.expr(f"contains(word, {quoted(t)}) OR {word_score('word', t)} > 0") for i, t in enumerate(query.tokens)}
        tried = self.vocabulary.where(F.col("side") == side).select("word", "df", *(c.alias(n) for n, c in hit.items())).where(" OR ".join(hit))
        found = tried.limit(MOST_WORDS + 1).collect()  # bounded
        if len(found) > MOST_WORDS:
            return self.rows, self.size <= MOST_SORTED
        words = [[r["word"] for r in found if r[f"hit{i}"]] for i in tokens]
        if not all(words):
            return self.rows.where(F.lit(False)), True
        most = min(sum(r["df"] for r in found if r[f"hit{i}"]) for i in tokens)
        if self._pays(most):
            met = self.words.where((F.col("side") == side) & F.col("word").isin([r["word"] for r in found])).groupBy("idx").agg(*(F.max(F.col("word").isin(w)).alias(f"hit{i}") for i, w in enumerate(words)))
            return self.rows.join(F.broadcast(met.where(" AND ".join(hit)).select("idx")), "idx", "left_semi"), True
        holds = [F.arrays_overlap(F.col(f"{side}_words"), F.array(*map(F.lit, w))) for w in words]
        return self.rows.where(reduce(lambda a, b: a & b, holds)), most <= MOST_SORTED

    def search(self, text: str | None, situation: str | None = None, limit: int | None = None, exhaustive: bool = False, complete: bool = False) -> DataFrame:
        """search(), scoring only candidates unless exhaustive.

        By default candidates come from probed trigrams: fuzzy matches that share none are not found. With complete=True they come
        from the vocabulary, and the answer is the exhaustive one.
        """
        query = parse_query(text)
        if exhaustive or query.blank or not query.tokens:
            return search(self.rows, text, situation, limit, limit is None and self.size <= MOST_SORTED)
        rows, few = self._complete_pool(query) if complete else self._pool(query)
        return search(rows, text, situation, limit, few)


def batch_search(rows: DataFrame, queries: list[str], limit: int) -> DataFrame:
    """query, rank and the result columns of each query's first `limit` rows; one pass over the rows for all queries.

    Scores of all queries are computed beside each other and exploded only where they match; each query's head is taken by a
    ranked window over its own matches.
    """
    parsed = [(q, parse_query(q)) for q in queries]
    live = [(q, p) for q, p in parsed if p.tokens]
    tokens = sorted({(_side(p), t) for _, p in live for t in p.tokens})
    d = rows.withColumns({f"_t{i}": token_score(t, s) for i, (s, t) in enumerate(tokens)})
    at = {k: f"_t{i}" for i, k in enumerate(tokens)}
    found = []
    for q, p in live:
        own = [at[_side(p), t] for t in p.tokens]
        score = row_score(p, own, _side(p))
        found.append(F.when(F.expr(" and ".join(f"{c} > 0" for c in own)), F.struct(F.lit(q).alias("query"), score.alias("score"))))
    keep = [c for c in rows.columns if c not in KEYS]
    hits = d.select(*keep, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(*keep, "x.query", "x.score")
    ranks = F.row_number().over(Window.partitionBy("query").orderBy(*order()))
    return hits.withColumn("rank", ranks).where(F.col("rank") <= limit)
