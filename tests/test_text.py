import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phrasewright.functions import query_text as Q
from phrasewright.functions import text as T

ROMAN = {
    "ज़ि": ("jai", "jai"), "बाज़ार": ("baajaaara", "bajara"), "फ़ोन": ("phaona", "faona"), "लिफ़्ट": ("liphata", "lifata"), "लिफ्ट": ("liphta", "lifta"),
    "शेजाऱ्या": ("shejaayaa", "shejaya"), "स्टॉप": ("stapa", "stapa"), "बँक": ("banka", "banka"), "कितना": ("kitanaa", "kitana"), "कहाँ": ("kahaan", "kahan"), "पाणी": ("paanee", "pani"), "ऑफिस": ("phisa", "fisa"),
}
FOLDED = {
    "kitnaa": "kitna", "kithnaa": "kithna", "kitana": "kitana", "phone": "fone", "water": "vater", "bhookh": "bhukh", "will": "vil", "ATM 12": "atm", "I'm  here": "im here",
    "chhuck": "chuk", "zoo": "ju", "caffè": "caf", "a\t\tb c": "a b c", "": "",
}
CLEANED = {"  क़लम, 'है'?  ": "कलम है", "A-B: c।": "a-b: c", "​क‍": "क", "ऱ": "ऱ"}


def test_goldens_on_the_driver():
    for text, (roman, folded) in ROMAN.items():
        assert (Q.to_roman(text), Q.fold(Q.to_roman(text))) == (roman, folded)
    for text, folded in FOLDED.items():
        assert Q.fold(text) == folded
    for text, cleaned in CLEANED.items():
        assert Q.norm_dev(text) == cleaned


HARD = [*ROMAN, *FOLDED, *CLEANED, "क़ख़ग़ज़ड़ढ़फ़य़", "été", "ΑΣ ς", "İstanbul K", "दु:ख १२३ abc", "𝒜 क्ष", " x y", "AAaa ééé", "chhchh ckck", "wwzz phph", None]


def test_columns_agree_with_the_driver_forms(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(HARD)], "i int, s string").select("i", "s", T.nfc("s").alias("n"))
    rows = df.select("s", T.fold(F.col("s")).alias("fold"), T.to_roman(F.col("n")).alias("roman"), T.norm_dev(F.col("n")).alias("dev"), T.is_devanagari(F.coalesce("s", F.lit(""))).alias("is")).collect()
    for r in rows:
        s = r["s"] or ""
        assert (r["fold"], r["roman"], r["dev"], r["is"]) == (Q.fold(s), Q.to_roman(s), Q.norm_dev(s), Q.parse_query(s).devanagari), s


def test_lengths_and_grams(spark):
    df = spark.createDataFrame([("a𝒜b",), ("ab",), ("aaaa",), ("",)], "s string")
    got = df.select(T.js_length(F.col("s")), T.ngrams(F.col("s"), 3), T.ngrams(F.col("s"), 2)).collect()
    assert [tuple(r) for r in got] == [(4, ["a𝒜b"], ["a𝒜", "𝒜b"]), (2, [], ["ab"]), (4, ["aaa"], ["aa"]), (0, [], [])]


def test_escape(spark):
    assert spark.createDataFrame([("""<a b="c">&'x'</a>""",), (None,)], "s string").select(T.escape_html(F.col("s"))).collect() == [("&lt;a b=&quot;c&quot;&gt;&amp;&#39;x&#39;&lt;/a&gt;",), ("",)]


@given(st.text(alphabet="abcehikoptuwz ABK'क़ाि्ं1\t", max_size=20))
def test_fold_leaves_only_letters_and_single_spaces(s):
    f = Q.fold(s)
    assert set(f) <= set("abcdefghijklmnopqrstuvwxyz ") and f == f.strip() and "  " not in f
    assert all(a != b for a, b in zip(f, f[1:], strict=False))


@given(st.text(max_size=20))
def test_norm_dev_takes_any_composition(s):
    assert Q.norm_dev(s) == Q.norm_dev(unicodedata.normalize("NFC", s))


@pytest.mark.parametrize(
    ("text", "dev", "tokens"),
    [("", False, ()), ("123", False, ()), ("???", False, ()), ("।", True, ()), ("i am", False, ("i", "am")), ("will you", False, ("vil",)), ("the the red red", False, ("red", "red")), ("the", False, ("the",)), ("red लाल", True, ("red", "लाल"))],
)
def test_query_parsing(text, dev, tokens):
    q = Q.parse_query(text)
    assert (q.devanagari, q.tokens) == (dev, tokens)
