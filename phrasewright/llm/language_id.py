"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled running text. A text is parsed against each
automaton by longest matches, which run on across words: the language whose sample covers it in the fewest phrases, normalised by
the sample's size and the text's length, wins. Texts are learned and parsed as runs of letters in lower case with single spaces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: The sample that is learned from: of each language so many distinct texts are looked at, each up to so many characters, until so many
#: characters are found; of more languages than this, less of each.
SAMPLE_TEXTS, LONGEST_TEXT, SAMPLE_CHARS, MOST_LANGUAGES = 400, 4_000, 20_000, 64

_WORD = re.compile(r"[^\W\d_]+")


def running(text: str) -> str:
    """A text's runs of letters in lower case, each between single spaces; digits and punctuation say nothing about its language."""
    words = _WORD.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


class SuffixAutomaton:
    """All substrings of some texts."""

    def __init__(self, texts: list[str]):
        next_: list[dict[str, int]] = [{}]
        length, link = [0], [-1]

        def copy(q: int, p: int, c: str) -> int:
            """A state for the shorter strings of q that go on from p by c; the ways that led to q for them lead there."""
            made = len(next_)
            next_.append(dict(next_[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = made
            while p >= 0 and next_[p].get(c) == q:
                next_[p][c] = made
                p = link[p]
            return made

        for text in texts:
            last = 0
            for c in text:
                q = next_[last].get(c)
                if q is not None:  # known from another text
                    last = q if length[q] == length[last] + 1 else copy(q, last, c)
                    continue
                own, p = len(next_), last
                next_.append({})
                length.append(length[last] + 1)
                link.append(0)
                while p >= 0 and c not in next_[p]:
                    next_[p][c] = own
                    p = link[p]
                if p >= 0:
                    q = next_[p][c]
                    link[own] = q if length[q] == length[p] + 1 else copy(q, p, c)
                last = own
        #: states as dicts that hold each other
        states: list[dict] = [{} for _ in next_]
        for state, to in zip(states, next_, strict=True):
            state.update((c, states[q]) for c, q in to.items())
        self.root = states[0]

    def phrases(self, text: str) -> int:
        """How many longest matches, one after another, make up the text; an unknown character is a phrase."""
        root = state = self.root
        n = 0
        for c in text:
            to = state.get(c)
            if to is None:
                n += 1
                to = root.get(c)
                if to is None:
                    n += state is not root
                    to = root
            state = to
        return n + (state is not root)


class Model:
    """Automata of a sample; made once in each Python worker."""

    _made: dict[int, Model] = {}

    def __init__(self, sample: dict[str, list[str]]):
        self.langs = sorted(sample)
        self.automata = [SuffixAutomaton(sample[k]) for k in self.langs]
        self.bits = np.array([math.log2(2 + sum(map(len, sample[k]))) for k in self.langs])

    @classmethod
    def of(cls, key: int, sample: dict[str, list[str]]) -> Model:
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(sample)
        return cls._made[key]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score) of a text; the score is how much shorter the winner's parse is than the next one's."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        own = running(text)
        cost = np.array([a.phrases(own) for a in self.automata]) * self.bits / len(own)
        best = int(cost.argmin())
        rest = np.delete(cost, best)
        return self.langs[best], float(np.clip(1 - cost[best] / rest.min(), 0, 1)) if len(rest) else 1.0


def learn(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, longest: int = LONGEST_TEXT, chars: int = SAMPLE_CHARS, languages: int = MOST_LANGUAGES
) -> dict[str, list[str]]:
    """A bounded sample of running text for each language, chosen by the texts' hashes, so alike for any partitioning and any number of copies.

    The `texts` distinct texts of smallest hash are taken in their order, of each at most the first `longest` characters, until there are
    `chars` characters; with more than `languages` languages both numbers shrink in proportion, to one text at least. What comes
    to the driver is about `languages` * (`chars` + `longest`) characters at most. Null texts and languages, and texts without a letter, are
    left out; a language with nothing else is not learned.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null").select("lang", F.xxhash64("text").alias("h"), F.left("text", F.lit(longest)).alias("text")).where(r"text rlike '\\p{L}'")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not counts:
        return {}
    less = max(1.0, len(counts) / languages)
    most_texts, most_chars = max(1, int(texts / less)), max(1, int(chars / less))
    # hashes below a bound that holds more than enough of them; copies of a text meet before they are sent
    enough = 4 * most_texts + 100
    bounds = [(r["lang"], -(1 << 63) + min((1 << 64) - 1, (enough << 64) // max(1, r["n"]))) for r in counts]
    some = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang").where("h <= bound").groupBy("lang", "h").agg(F.min("text").alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("h")
    before = F.sum(F.length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, -1))
    found = some.withColumns({"i": F.row_number().over(by_hash), "before": F.coalesce(before, F.lit(0))}).where((F.col("i") <= most_texts) & (F.col("before") < most_chars)).collect()
    sample: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["h"], r["text"])):
        own, left = running(r["text"]), most_chars - sum(map(len, sample.get(r["lang"], ())))
        if len(own) > left or len(r["text"]) >= longest:  # the last word may be cut
            own = own[: left + 1]
            own = own[: own.rstrip(" ").rfind(" ") + 1] or own
        if own.strip(" ") and left > 0:
            sample.setdefault(r["lang"], []).append(own)
    return sample


def identify(df: DataFrame, sample: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row, from its whole text alone. Null text, and text without a letter, is `und` with score 0.

    Equal parses go to the first language by name. Every row gives one row, whatever its id. Other columns play no part; no rows give no rows.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(sample)  # as bounded as learn() makes it
    key = hash(tuple((k, tuple(v)) for k, v in sorted(sample.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(key, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [model.predict(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
