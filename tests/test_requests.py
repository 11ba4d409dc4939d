from phrasewright.functions.score import word_hit
from phrasewright.operators.highlight import highlight
from phrasewright.operators.rows import index_rows
from phrasewright.operators.search import search
from phrasewright.streaming import requests
from phrasewright.streaming.requests import answer, latest_requests, search_stream

SCHEMA = "session long, seq long, q string, situation string"


def phrases(spark):
    return index_rows(spark.createDataFrame([(1, "red bolt", "a"), (2, "red widget", "b"), (3, "blue bolt", "a")], "idx long, english string, situation string")).cache()


def test_only_the_latest_request_of_a_session_counts(spark):
    asked = spark.createDataFrame([(1, 1, "red", ""), (1, 3, "bolt", ""), (1, 2, "blue", ""), (2, 9, "red", "a"), (3, 1, " ", None)], SCHEMA)
    assert {(r["session"], r["q"]) for r in latest_requests(asked).collect()} == {(1, "bolt"), (2, "red"), (3, " ")}
    found = answer(phrases(spark), asked).collect()
    assert {(r["session"], r["idx"]) for r in found} == {(1, 1), (1, 3), (2, 1)}
    assert answer(phrases(spark), asked.limit(0)).count() == 0


def test_requests_as_a_stream(spark, tmp_path):
    rows, got = phrases(spark), []
    spark.createDataFrame([(1, 1, "red", ""), (1, 2, "widget", "")], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = search_stream(stream, rows, lambda df, n: got.extend(df.collect()), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert [(r["session"], r["seq"], r["idx"]) for r in got] == [(1, 2, 2)]


def test_requests_of_many_queries_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(requests, "PASS", 2)
    asked = spark.createDataFrame([(1, 1, "red", ""), (2, 1, "bolt", ""), (3, 1, "blue", "a"), (4, 1, "widget", "b"), (5, 1, "bolt", None)], SCHEMA)
    assert len(list(requests.answers(phrases(spark), asked))) == 2
    assert {(r["session"], r["idx"]) for r in answer(phrases(spark), asked).collect()} == {(1, 1), (1, 2), (2, 1), (2, 3), (3, 3), (4, 2), (5, 1), (5, 3)}


def test_marks(spark):
    df = spark.createDataFrame([("the  red\t<widgets> कितना", "क")], "a string, b string")
    one = lambda q, c="a": highlight(df, c, q, "h").first()["h"]
    assert one("red wiget") == "the  <mark>red</mark>\t<mark>&lt;widgets&gt;</mark> कितना"
    assert one("the") == "<mark>the</mark>  red\t&lt;widgets&gt; कितना"
    assert one("kitna").endswith("<mark>कितना</mark>") and one("कितना").endswith("<mark>कितना</mark>")
    assert one("", "b") == "क" and one("???") == "the  red\t&lt;widgets&gt; कितना"


def test_word_hits(spark):
    pairs = [("kitana", "kitna", True), ("", "kit", False), ("station", "stat", True), ("xyabcqwz", "abc", False), ("abcde", "bcde", True), ("red", "read", False)]
    for word, token, want in pairs:
        assert spark.sql(f"select {word_hit(repr(word), token)}").first()[0] == want, (word, token)


def test_search_works_on_any_frame_with_idx(spark):
    assert search(phrases(spark), "bolt", situation="a").count() == 2
