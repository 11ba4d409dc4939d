import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasewright.llm.components import connected_components
from phrasewright.llm.near_dedup import keep_first_of_each, near_duplicates
from phrasewright.llm.queries import QUERIES
from phrasewright.llm.substring_dedup import difference_cover, remove_repeats

from ..holding import DATA
from . import brute

ODD = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one two", "x"), (5, "ONE  two", "x"), (None, "one two", "x"), (6, "a b c d e f g", "x"), (7, "a b c d e f g h", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def made_up(n, seed):
    """Texts with copies, edited copies, shared passages and chains of edits."""
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi omikron pi rho sigma tau".split()) + str(r.randint(0, 40))
    passages = [[word() for _ in range(r.randint(10, 40))] for _ in range(4)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out)[1].split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                at = r.randrange(len(w)) if w else 0
                w[at : at + r.randint(0, 1)] = [word() for _ in range(r.randint(0, 2))]
        else:
            w = [word() for _ in range(r.choice([3, 20, 60, 150]))]
        if r.random() < 0.3:
            w[len(w) // 2 : len(w) // 2] = r.choice(passages)
        out.append((i, " ".join(w) + r.choice(["", "\n", "  x"])))
    return [(i * 7 % n, t) for i, t in out]  # ids out of order


def test_near_query(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op8_minhash_near_dedup"](spark, DATA).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in brute.near(docs).items()}


def test_near_on_edited_copies(spark):
    rows = made_up(300, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == brute.near(rows)
    kept = {r[0] for r in keep_first_of_each(df).select("doc_id").collect()}
    assert kept == {d for d, (_, c) in brute.near(rows).items() if d == c}


def families(n, seed):
    """Families of a smaller document that is not near enough, and two that are near to each other: all share most of their keys."""
    r, out = random.Random(seed), []
    for i in range(n):
        w = [f"f{i}w{r.randrange(1000)}" for _ in range(200)]
        far = w[:150] + [f"f{i}o{k}" for k in range(50)]
        near = w[:196] + [f"f{i}n{k}" for k in range(4)]
        out += [(3 * i + k, " ".join(x)) for k, x in enumerate((far, w, near))]
    return out


def test_near_links_that_no_star_has(spark):
    rows = families(100, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    assert got == {d: c for d, (_, c) in brute.near(rows).items()} and sum(d != c for d, c in got.items()) >= 100


@pytest.mark.parametrize(("words", "n", "block"), [(12_000, 8, None), (200, 30, 1000)])
def test_near_in_groups_that_leave_cells_without_texts(spark, monkeypatch, words, n, block):
    """Three texts are dealt into two blocks by their length, or into eight where blocks are small: some blocks hold none, and no link is lost."""
    if block:
        monkeypatch.setattr("phrasewright.llm.near_dedup.BLOCK", block)
    r, rows = random.Random(9), []
    for i in range(n):
        w = [f"f{i}w{r.randrange(10**6)}" for _ in range(words)]
        far, near = w[: words * 3 // 4] + [f"f{i}o{k}" for k in range(words // 4)], w[: words * 49 // 50] + [f"f{i}n{k}" for k in range(words // 50)]
        rows += [(3 * i + k, " ".join(x)) for k, x in enumerate((far, w, near))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(df).collect()}
    assert got == brute.near(rows) and sum(d != c for d, (_, c) in got.items()) == n


def test_unlike_texts_with_common_parts_are_not_compared(spark):
    """Work on texts that share a third of their words grows as they do: few of them share a key."""
    from phrasewright.llm.common import materialise
    from phrasewright.llm.near_dedup import _stars, signatures

    common = " ".join(f"c{i}" for i in range(60))
    pairs = {}
    for n in (500, 5000):
        r = random.Random(n)
        docs = spark.createDataFrame([(i, common + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(140))) for i in range(n)], "doc_id long, text string")
        pairs[n] = _stars(materialise(signatures(docs), "signed"), 18, 64).count()
    assert pairs[500] <= 50 and pairs[5000] <= 40 * max(pairs[500], 10)


def test_dedup_beside_columns_of_any_name(spark):
    names = ["gone", "_gone", "of", "marks", "_of", "_marks", "h", "n_shingles", "component_id"]
    passage = " ".join(f"p{i}" for i in range(13))
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, passage + " a" * 30), (4, "b " * 30 + passage), (None, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    out = keep_first_of_each(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {1, 3, 4, None} and all(r[c] == c for r in out.collect() for c in names)
    out = remove_repeats(df)
    assert out.columns == [*df.columns, "n_words", "n_removed", "n_windows"] and all(r[c] == c for r in out.collect() for c in names)
    assert {r["doc_id"]: r["text"] for r in out.collect()}[4].split() == ["b"] * 30


def test_what_is_too_much_to_send_is_exchanged(spark, monkeypatch):
    rows = made_up(150, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr("phrasewright.llm.near_dedup.few", lambda written: False)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()} == brute.near(rows)
    assert {r[0] for r in keep_first_of_each(df).select("doc_id").collect()} == {d for d, (_, c) in brute.near(rows).items() if d == c}


def test_near_odd_rows(spark):
    df = spark.createDataFrame([*ODD, ODD[3], (5, "ONE  two", "y")], "doc_id long, text string, n_shingles string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True), (6, 3, 6, True), (7, 4, 6, False)], key=str
    )
    assert near_duplicates(df.limit(0)).count() == 0
    assert keep_first_of_each(df).columns == df.columns


def test_near_refuses_odd_thresholds(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame(ODD, "doc_id long, text string, x string"), percent=0)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (202, 201), (200, 202), (300, 300), (None, 1), (5, 4)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {i: 200 for i in (200, 201, 202)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_difference_covers():
    for period in range(1, 14):
        own = difference_cover(period)
        assert {(a - b) % period for a in own for b in own} == set(range(period))
    assert len(difference_cover(7)) == 3 and len(difference_cover(13)) == 4


def substring_rows(df):
    out = remove_repeats(df, joined=True).withColumn("s", F.sha2(F.col("text").cast("binary"), 256))
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["s"]) for r in out.collect()}


def test_substring_query(spark, docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op10_substring_dedup"](spark, DATA).collect()}
    assert got == brute.substring(docs)


@pytest.mark.parametrize("seed", [2, 3])
def test_substring_on_shared_passages(spark, seed):
    rows = made_up(200, seed)
    assert substring_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute.substring(rows)


@pytest.mark.parametrize(("window", "period"), [(13, 1), (13, 13), (5, 3)])
def test_substring_with_other_windows(spark, window, period):
    rows = made_up(120, 4)
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window, period=period).collect()}
    assert got == {d: v[1] for d, v in brute.substring(rows, window).items()}


def test_substring_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(1, None, "x"), (2, "", "x"), (3, f"a\n{passage}  z", "x"), (4, f"q {passage}\tend \n", "x"), (4, f"q {passage}\tend \n", "y"), (None, passage, "x"), (8, passage, "x"), (9, long, "x"), (10, long + " tail", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in remove_repeats(df).collect()), key=str)
    want = [(1, None, 0), (2, "", 0), (3, rows[2][1], 0), (4, "q end \n", 13), (4, "q end \n", 13), (None, passage, 0), (8, "", 13), (9, long, 0), (10, "tail", 30_000)]
    assert got == sorted(want, key=str)
    assert remove_repeats(df.limit(0)).count() == 0
    assert remove_repeats(df.select(F.col("doc_id").cast("int").alias("k"), F.col("text").alias("t"), F.lit(1).alias("doc_id")), "k", "t").columns == ["k", "t", "doc_id", "n_words", "n_removed", "n_windows"]


def test_word_hashes_tell_words_apart():
    from phrasewright.llm.wordhash import Words

    texts = ["a bc", "ab c", "abc", "", "A\tbc\x0b\x0c d", "é è", " "]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    w = Words(raw, offs, lower=True)
    assert list(w.count) == [len(t.split()) for t in texts]
    names = [x for t in texts for x in t.lower().split()]
    assert len({(n, int(h)) for n, h in zip(names, w.hash, strict=True)}) == len(set(names)) == len(set(map(int, w.hash)))
