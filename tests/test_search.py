import pytest

from phrasewright.functions.query_text import parse_query
from phrasewright.operators.rows import index_rows, spread, strip
from phrasewright.operators.search import PhraseIndex, batch_search, ranked, search

from . import plain

# our own small phrasebook
ROWS = [
    ("पानी कहाँ है?", "पाणी कुठे आहे?", "where is the water?", "", "food", "", "curated"), ("कितना हुआ?", "किती झाले?", "how much is it?", "kitna hua", "market", "ok", "curated"),
    ("टिकट दीजिए", "तिकीट द्या", "a ticket please", "", "travel", "ok", "curated"), ("मुझे टिकट चाहिए", "मला तिकीट हवे", "I need a ticket", "", "travel", "built", "built"),
    ("स्टेशन कहाँ है", "स्टेशन कुठे आहे", "where is the station", "", "travel", "built", "built"), ("लाल फूल", "लाल फूल", "red flower", "lal phool", "market", "", "corpus"),
    ("पानी", "पाणी", "water", "", "food", "corpus", "corpus"), ("", "", "", "", "", "", "curated"), ("चाय", "चहा", "tea / chai (hot)", "", "food", "ok", "curated"), ("चाय", "चहा", "tea / chai (hot)", "", "food", "ok", "curated"),
]
NAMES = ("hindi", "marathi", "english", "roman", "situation", "status", "tier")
TEXTS = ["kitna", "kithnaa", "paani kahan hai", "ticket", "tikat", "where is the station", "how much", "i am", "chai", "चहा", "पाणी", "स्टेशन कुठे आहे", "कितना", "water", "vater", "st", "a", "red", "phool", "tiket please", "zzz", "123", "।", " ", "red पानी"]


@pytest.fixture(scope="module")
def rows():
    return [dict(zip(NAMES, r, strict=True), idx=i) for i, r in enumerate(ROWS)]


@pytest.fixture(scope="module")
def keyed(spark, rows):
    return index_rows(spark.createDataFrame([(r["idx"], *(r[n] for n in NAMES)) for r in rows], "idx long, " + ", ".join(f"{n} string" for n in NAMES))).cache()


def got(df):
    return [(r["idx"], r["score"]) for r in df.collect()]


@pytest.mark.parametrize("text", TEXTS)
def test_exhaustive_search_follows_the_rules(keyed, rows, text):
    want, have = plain.search(rows, text), got(search(keyed, text))
    assert [i for i, _ in have] == [i for i, _ in want]
    assert [s for _, s in have] == pytest.approx([s for _, s in want], abs=1e-12) or text.strip() == ""


@pytest.mark.parametrize("text", TEXTS)
def test_indexed_search_is_an_ordered_part_of_the_exhaustive_one(keyed, text):
    index = PhraseIndex.build(keyed)
    full, part = got(index.search(text, exhaustive=True)), got(index.search(text))
    left = iter(full)
    assert all(x in left for x in part)


@pytest.mark.parametrize("text", TEXTS)
def test_complete_search_is_the_exhaustive_one(keyed, text):
    assert got(PhraseIndex.build(keyed).search(text, complete=True)) == got(search(keyed, text))


@pytest.mark.parametrize("k", [0, 1, 3])
def test_a_limit_is_the_head_of_the_full_ranking(keyed, k):
    for text in ("ticket", "chai", ""):
        assert got(search(keyed, text, limit=k)) == got(search(keyed, text))[:k]


def test_situation_filters(keyed, rows):
    for text in ("ticket", "", "paani"):
        assert [i for i, _ in got(search(keyed, text, "food"))] == [i for i, _ in plain.search(rows, text, "food")]


def test_negative_limits_are_refused(keyed):
    with pytest.raises(ValueError):
        search(keyed, "x", limit=-1)


def test_missing_columns_and_nulls_are_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "red bolt")], "idx long, hindi string")
    assert [r["idx"] for r in search(index_rows(df), "bolt").collect()] == [2]
    assert search(index_rows(df.limit(0)), "bolt").count() == 0


def test_keys_are_stripped(keyed):
    assert set(strip(keyed).columns).isdisjoint({"dev", "rom", "en", "dev_words", "rom_words"})


def test_batch_gives_each_query_its_own_head(keyed):
    texts = ["ticket", "चहा", "paani kahan hai", "zzz"]
    found = batch_search(keyed, texts, 2).collect()
    for text in texts:
        own = sorted((r["rank"], r["idx"]) for r in found if r["query"] == text)
        assert [i for _, i in own] == [i for i, _ in got(search(keyed, text, limit=2))]


def test_ranks(keyed):
    assert [r["rank"] for r in ranked(search(keyed, "chai")).orderBy("rank").collect()] == list(range(1, 1 + search(keyed, "chai").count()))


def test_a_saved_index_answers_alike(keyed, tmp_path):
    saved = PhraseIndex.build(keyed).save(str(tmp_path / "index"))
    for text in ("ticket", "कुठे आहे"):
        assert got(saved.search(text)) == got(PhraseIndex.build(keyed).search(text))


@pytest.mark.parametrize(("most", "share"), [(0, 1.0), (200, 0.0), (200, 1.0)])
def test_candidates_from_rows_and_from_postings_are_the_same(keyed, monkeypatch, most, share):
    index = PhraseIndex.build(keyed)
    want = {t: got(keyed.join(index.candidates(parse_query(t)), "idx", "left_semi").transform(lambda d, t=t: search(d, t))) for t in ("ticket", "paani kahan hai", "कुठे आहे", "tikat ab")}
    monkeypatch.setattr("phrasewright.operators.search.LEAST_ROWS", 0)
    monkeypatch.setattr("phrasewright.operators.search.MOST_CANDIDATES", most)
    monkeypatch.setattr("phrasewright.operators.search.SELECTIVE", share)
    assert {t: got(PhraseIndex.build(keyed).search(t)) for t in want} == want
    assert all(got(index.search(t, complete=True)) == got(search(keyed, t)) for t in want)


def test_many_tokens(keyed):
    text = " ".join(["where", "is", "the", "station"] * 20)
    assert got(PhraseIndex.build(keyed).search(text, complete=True)) == got(search(keyed, text)) != []


def test_gram_counts_are_read_once(keyed, monkeypatch):
    index = PhraseIndex.build(keyed)
    whole = index.gram_df("rom", ["tik", "zzz"])
    monkeypatch.setattr("phrasewright.operators.search.MOST_GRAMS", 3)
    asked = PhraseIndex.build(keyed)
    assert asked.gram_df("rom", ["tik", "zzz"]) == whole != {} and asked._df[("rom", "zzz")] == 0 and len(asked._df) == 2


def test_a_head_needs_no_exchange(keyed):
    plan = search(keyed, "red wiget", limit=10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.split("InMemoryRelation")[0]


def test_keys_are_computed_once_for_a_row(spark):
    rows = index_rows(spark.createDataFrame([(1, "red bolt")], "idx long, hindi string"), compose=False)
    once = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    assert once(search(rows, "smal promo gear")) == once(search(rows, "gear")) == once(rows.select("idx", "rom", "rom_words"))


def test_ranges_of_the_order_are_sampled_from_scored_rows(keyed):
    plan = search(keyed, "red wiget")._jdf.queryExecution().sparkPlan().toString().split("InMemoryRelation")[0]
    assert plan.index("Sort") < plan.index("REPARTITION") < plan.index("Filter")


def test_a_file_of_one_piece_is_dealt_over_the_cores(spark, tmp_path):
    spark.range(1000).repartition(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    dealt = spread(scan, "id")
    assert dealt.rdd.getNumPartitions() == 24 and sorted(r["id"] for r in dealt.collect()) == list(range(1000))
    assert spread(spark.range(0, 1000, 1, 50), "id").rdd.getNumPartitions() == 50


def test_postings_of_one_gram_are_dealt_over_several_files(spark, keyed, tmp_path):
    # the session's own sizes would put so little into one file
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same = index_rows(spark.range(2000).selectExpr("id as idx", "'bolt' as hindi"), compose=False)
        saved = PhraseIndex.build(same).save(str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = saved.postings.where("side = 'rom' and gram = 'bol'")
    assert held.count() == 2000 and len({r[0] for r in held.selectExpr("input_file_name()").distinct().collect()}) > 1
