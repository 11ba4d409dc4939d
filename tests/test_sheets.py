import pytest

from phrasewright.functions.text import SPACES
from phrasewright.operators.templates import expand
from phrasewright.sources.csv import parse_rows, read_sheet, read_sheet_strict
from phrasewright.sources.synthetic import Draws, corpus_of, made_up_nouns, noun_table
from phrasewright.sources.tiers import load_tiers

CASES = {
    "a,b\n1,2\n": [["a", "b"], ["1", "2"]], 'a,b\n"x,1","y ""q"""': [["a", "b"], ["x,1", 'y "q"']], 'a,b\nx"1,2"y, z': [["a", "b"], ["x1,2y", " z"]], 'a\n"l1\nl2"': [["a"], ["l1\nl2"]],
    "a,b\r\n1,2\r3,4": [["a", "b"], ["1", "2"], ["3", "4"]], 'a\n"open,\nto the end': [["a"], ["open,\nto the end"]], "\n , \na,b\n\n1\n": [["a", "b"], ["1"]], "": [], "a,b": [["a", "b"]],
}


@pytest.mark.parametrize("text", CASES)
def test_tolerant_rows(text):
    assert parse_rows(text) == CASES[text]


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_strict_sheet(spark, tmp_path):
    df = read_sheet_strict(spark, write(tmp_path / "a.csv", "﻿hindi , english\n x ,y,extra\nz\n"), ("hindi", "note"))
    assert [tuple(r) for r in df.select("ord", "hindi", "english", "note").orderBy("ord").collect()] == [(1, "x", "y", ""), (2, "z", "", "")]


@pytest.mark.parametrize("text", ["", "a,b\n", "\n\n"])
def test_empty_sheets_have_no_rows(spark, tmp_path, text):
    df = read_sheet_strict(spark, write(tmp_path / "a.csv", text), ("a",))
    assert df.count() == 0 and "a" in df.columns


def test_missing_sheet(spark, tmp_path):
    assert read_sheet_strict(spark, str(tmp_path / "none.csv"), ("a",)).count() == 0


def test_plain_sheet(spark, tmp_path):
    df = read_sheet(spark, write(tmp_path / "a.csv", 'a, b\n1,"x ""y"""\n , \n2\n'))
    assert sorted(map(tuple, df.collect())) == [("1", 'x "y"'), ("2", "")]


@pytest.mark.parametrize("size", ["7", "40", "1000"])
def test_a_sheet_in_pieces_is_the_sheet(spark, tmp_path, size):
    cells = ['plain', '"quoted, ""twice"""', '"two\nlines"', '"\n\n"', 'x"1,2"y', '', '"carriage\rreturn"', '"a long\ncell over\nmany, many\nlines and\npieces"', 'क़लम ']
    ends = ["\n", "\r\n", "\r", "\n , \n"]
    text = "\n\ufeffa,b\n" + "".join(f"{cells[i % 9]},{i}{ends[i // 9 % 4]}" for i in range(150)) + '"open,\nto\nthe end of\nthe whole\nfile\n'
    path = write(tmp_path / "a.csv", text)
    want = [tuple(c.strip(SPACES) for c in [*r, ""][:2]) for r in parse_rows(text)][1:]
    confs = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        df = read_sheet_strict(spark, path)
        assert df.rdd.getNumPartitions() > 1  # a file was one task's work
        got = [tuple(r) for r in df.orderBy("ord").select("ord", "a", "b").collect()]
    finally:
        for k in confs:
            spark.conf.unset(k)
    assert got == [(i, *r) for i, r in enumerate(want, 1)]


PATTERNS = [
    (1, "p1", "{X} बड़ा", "{X} बड़ी", "", "{X} मोठा", "{X} मोठी", "{X} मोठे", "big {X}, {X}", "direct", "thing|thing", ""), (2, "p2", "{X} को", "", "", "{X}ला", "", "", "to {X}", "dative", "", "n"),
    (3, "p3", "{X}", "{X}", "{X}", "", "", "", "never", "direct", "", ""), (4, "p4", "{X} में {X}", "", "", "{X}मध्ये", "", "", None, "oblique", " person ", None),
]
NOUNS = [(1, "चाय", "चहा", "tea", "f", "m", "चहा", "", "thing"), (2, "डॉक्टर", "डॉक्टर", "doctor", "M", "m", "डॉक्टरां", "1", "person"), (3, "x$1", "y$&", "$", "?", "", "", "", "thing")]
PATTERN_SCHEMA = "ord int, id string, hi_m string, hi_f string, hi_n string, mr_m string, mr_f string, mr_n string, en string, form string, takes string, note string"
NOUN_SCHEMA = "ord int, hi string, mr string, en string, hi_gender string, mr_gender string, mr_oblique string, honorific string, category string"


def test_templates(spark):
    built = expand(spark.createDataFrame(PATTERNS, PATTERN_SCHEMA), spark.createDataFrame(NOUNS, NOUN_SCHEMA)).orderBy("idx").collect()
    assert [(r["hindi"], r["marathi"], r["english"], r["source"], r["situation"]) for r in built] == [
        ("चाय बड़ी", "चहा मोठा", "big tea, tea", "p1", "thing"), ("x$1 बड़ा", "y$& मोठे", "big $, $", "p1", "thing"), ("चाय को", "चहाला", "to tea", "p2", "thing"), ("डॉक्टर को", "डॉक्टरांना", "to doctor", "p2", "person"),
        ("x$1 को", "y$&ला", "to $", "p2", "thing"), ("डॉक्टर में {X}", "डॉक्टरांमध्ये", "", "p4", "person"),
    ]
    assert {r["status"] for r in built} == {r["tier"] for r in built} == {"built"}


def test_tiers(spark, tmp_path):
    sheet = lambda name, head, rows: (tmp_path / name).write_text("\n".join([head, *rows]), encoding="utf-8")
    sheet("phrases.csv", "hindi,marathi,roman,situation,note,tier", ["क,ख,,b,,x", "ग,घ,,a,,", "ङ,च,,b,,"])
    sheet("patterns.csv", "id,hi_m,hi_f,hi_n,mr_m,mr_f,mr_n,en,form,takes,note", ["p1,{X} है,,,{X} आहे,,,it is {X},direct,,"])
    sheet("nouns.csv", "hi,mr,en,hi_gender,mr_gender,mr_oblique,honorific,category", ["चाय,चहा,tea,f,m,,,food"])
    t = load_tiers(spark, str(tmp_path))
    assert [(r["hindi"], r["tier"]) for r in t.rows.orderBy("idx").collect()] == [("क", "curated"), ("ग", "curated"), ("ङ", "curated"), ("चाय है", "built")]
    assert [r["situation"] for r in t.situations.orderBy("first_idx").collect()] == ["b", "a"]
    assert tuple(t.counts.first()) == (3, 1, 0) and t.label.first()[0] == "3 phrases + 1 built"
    empty = load_tiers(spark, str(tmp_path / "none"))
    assert empty.rows.count() == 0 and empty.label.first()[0] == "0 phrases"


def test_made_up_nouns_go_on_from_the_seed(spark):
    whole, draw = list(made_up_nouns(0, 20, ["a", "b"], Draws())), Draws()
    assert list(made_up_nouns(0, 8, ["a", "b"], draw)) + list(made_up_nouns(8, 20, ["a", "b"], draw)) == whole
    assert noun_table(spark, 0, 5, ["a"], Draws()).count() == 5


def test_a_corpus_grows_by_its_nouns(spark):
    base = spark.createDataFrame([(1, "क")], "idx long, hindi string")
    patterns, nouns = spark.createDataFrame(PATTERNS, PATTERN_SCHEMA), spark.createDataFrame(NOUNS, NOUN_SCHEMA)
    small, large = (corpus_of(base, patterns, nouns, n, Draws()) for n in (3, 30))
    assert small.count() == 1 + 6 and large.count() > 1 + 6 + 27 and large.select("idx").distinct().count() == large.count()
