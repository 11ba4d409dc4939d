import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasewright.llm import oracles
from phrasewright.llm.chat_format import digests, format_conversations, parse, round_trip
from phrasewright.llm.language_id import SuffixAutomaton, identify, learn, running
from phrasewright.llm.nearest import CrossPolytope, cheapest, hadamard, nearest
from phrasewright.llm.quality_rules import keep_good, quality_verdicts
from phrasewright.llm.queries import ORACLE_SQL, QUERIES
from phrasewright.llm.secret_scan import RULES, find_secrets, redact, secret_report
from phrasewright.llm.trigram_query import trigram_query

from ..holding import DATA, connection, same
from . import brute


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name], connection())


#: names that helpers have, or had, inside the operators
CLASHING = ["row", "g0", "g1", "f0", "q", "t", "w", "n", "kept", "_kept", "_q", "_t", "s", "low_word_length"]


# --- quality ---
def test_quality_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \n\x0b ", "en", "a"), (4, words, "en", None), (4, words, "en", None), (None, words, None, "b"), (5, "a b c d e " * 4, "en", "a"), (6, "x\nx\n\n \n \nx y z q w e r t u", "en", "a"),
        (7, "é # <b>|</b> " * 3, "fr", "a"), (8, "a b c d e f g h i j a b c d e", "en", "a"), (9, "z " * 20_000, "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(c) for c in CLASHING})
    got = sorted((tuple(r)[:-1] for r in quality_verdicts(df).collect()), key=str)
    good = keep_good(df)
    assert good.columns == df.columns and all(r[c] == c for r in good.collect() for c in CLASHING)
    kept = {r["doc_id"] for r in quality_verdicts(df).where("kept").collect()}
    assert sorted(((r["doc_id"], r["text"]) for r in good.collect()), key=str) == sorted(((d, t) for d, t, _, _ in rows if d in kept), key=str)
    assert got == sorted(((d, *brute.quality_counts(t)) for d, t, _, _ in rows), key=str)
    assert all(not r["kept"] for r in quality_verdicts(df).collect() if r["base_failed"])
    assert quality_verdicts(df.limit(0)).count() == 0 and keep_good(df.limit(0)).count() == 0


def test_thresholds_follow_their_group(spark):
    clean = [(i, " ".join(f"wo{(i * j) % 97}" for j in range(1, 60)), "en", "a") for i in range(80)]
    marked = [(100 + i, " ".join(f"wo{(i * j) % 97}#" for j in range(1, 60)), "en", "b") for i in range(80)]
    stray = [(300, marked[3][1], "en", "a"), (301, clean[5][1], "en", "b")]
    df = spark.createDataFrame(clean + marked + stray, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(df).collect() if not r["base_failed"]}
    assert not kept[300] and kept[301] and all(kept.get(100 + i, True) for i in range(80))
    assert {r["doc_id"] for r in keep_good(df).collect()} == {d for d, k in kept.items() if k}


def test_rates_that_are_common_in_a_source_widen_its_fence(spark):
    text = lambda i, every: " ".join(f"wo{(i * j) % 97}" + ("#" if every and j % every == 0 else "") for j in range(1, 60))
    rich = [(i, text(i, 7 if i % 5 < 2 else 0), "en", "a") for i in range(1, 101)]  # two texts in five hold 135 symbols in 1000 words
    poor = [(200 + i, text(i, 7 if i % 10 == 0 else 0), "en", "b") for i in range(1, 101)]  # one in ten does
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(spark.createDataFrame(rich + poor, "doc_id long, text string, lang string, source string")).collect() if not r["base_failed"]}
    assert all(kept[i] for i, *_ in rich if i in kept) and not any(kept[200 + i] for i in range(10, 101, 10) if 200 + i in kept) and sum(kept.values()) > 150


def test_fences_of_small_groups_are_a_parameter(spark):
    rows = [(i, " ".join(f"wo{(i * j) % 97}" + ("#" if i >= 60 else "") for j in range(1, 60)), "en", "a" if i < 60 else "b") for i in range(65)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = lambda least: {r["doc_id"] for r in quality_verdicts(df, least=least).where("kept").collect()}
    assert not any(d >= 60 for d in kept(50)) and {d for d in kept(2) if d >= 60}


def test_quality_is_native(spark):
    plan = quality_verdicts(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- secrets ---
BITS = [
    "token", "TOKEN", "secret", " = ", "=", ":", '"', "'", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "AKIA1", "0123456789abcdef", "deadbeef" * 4, " ", "é🙂", "password", "api_key", "apikey", "ghp_" + "a1" * 18, "\n", "x", "xoxb-1234567890ab",
    "eyJ", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35, "İ",
]


def test_secrets_on_made_up_texts(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(BITS) for _ in range(r.randint(0, 12)))) for i in range(1500)] + [(9999, None), (None, "token=abcdefghijk"), (5, "dup token=abcdefghijk"), (9998, ""), (9997, "é" * 30_000 + "secret: 12345678")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secrets", F.lit(1)).repartition(6)
    got = sorted(((x["doc_id"], x["n_assign"], x["n_access"], x["n_hex"], x["base_sha256"]) for x in secret_report(df).collect()), key=str)
    want = []
    for d, t in rows:
        found = brute.secrets(t)
        want.append((d, *(sum(s[2] == k for s in found) for k in ("assign", "access", "hex")), brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))))
    assert got == sorted(want, key=str)
    same(secret_report(df), oracles.op7().replace("FROM documents", "FROM made"), _with(rows))
    assert secret_report(df.limit(0)).count() == 0


def test_places_of_very_many_secrets(spark):
    text = "".join(f"x{i} token={i:08d} " + ("é" if i % 7 == 0 else "") for i in range(5000))
    df = spark.createDataFrame([(1, text), (2, "AKIA" + "A" * 12 + " "), (3, "ghp_" + "zQ" * 18)], "doc_id long, text string")
    for most in (0, 10):
        found = {r["doc_id"]: [(x["start"], x["rank"], x["kind"], x["stop"]) for x in r["secrets"]] for r in find_secrets(df, most=most).collect()}
        assert found[1] == brute.secrets(text) and len(found[1]) == 5000 and found[2] == [(0, 1, "access", 16)] and [x[2] for x in found[3]] == ["github"]
        assert {r["doc_id"]: r["text"].count("[SECRET]") for r in redact(df, most=most).collect()} == {1: 5000, 2: 1, 3: 1}


def test_secrets_beside_columns_of_any_name(spark):
    names = ["of", "rules", "spans", "secrets", "_of", "_text", "_rules", "m", "a", "low"]
    df = spark.createDataFrame([(1, "é token=abcdefgh1 end"), (2, None), (None, "clean")], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    for most in (0, 10):
        out = redact(df, most=most)
        assert out.columns == df.columns and all(r[c] == c for r in out.collect() for c in names)
        assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "é [SECRET] end", 2: None, None: "clean"}
        assert {r["doc_id"]: (r["of"], len(r["secrets"])) for r in find_secrets(df, most=most).collect()} == {1: ("of", 1), 2: ("of", 0), None: ("of", 0)}


def test_overlapping_secrets_are_masked_as_one(spark):
    df = spark.createDataFrame([(1, "a token=AKIAABCDEFGHIJKLMN.deadbeefdeadbeefdeadbeefdeadbeef z token=12345678")], "doc_id long, text string")
    assert redact(df).first()["text"] == "a [SECRET] z [SECRET]"


def _with(rows):
    con = connection()
    con.execute("create table made (doc_id bigint, text varchar)")
    con.executemany("insert into made values (?, ?)", rows)
    return con


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdefgh1 end", 1), (2, None, 1), (3, "clean", 1), (None, "token = deadbeefdeadbeefdeadbeefdeadbeef.", 1)], "doc_id long, text string, secrets int")
    assert {r["doc_id"]: r["text"] for r in redact(df).collect()} == {1: "é [SECRET] end", 2: None, 3: "clean", None: "[SECRET]"}
    assert find_secrets(redact(df)).where("size(secrets) > 0").count() == 0


def test_trigram_queries_let_no_match_slip():
    assert trigram_query("[0-9a-f]{32,}") is None and trigram_query("ab|cdef") is None and trigram_query("a?") is None
    assert trigram_query("abcd") == [frozenset({"abc", "bcd"})] and trigram_query("(abc|xyz)+Q?") == [frozenset({"abc"}), frozenset({"xyz"})]
    r = random.Random(1)
    for rule in RULES:
        query = trigram_query(rule.pattern)
        for _ in range(300):
            t = "".join(r.choice(BITS) for _ in range(6))
            if query and re.search(rule.pattern, t, re.I if rule.ignore_case else 0):
                low = t.lower()
                assert any(all(g in low for g in s) for s in query), (rule.kind, t)


# --- languages ---
def test_language_query_on_held_out_rows(spark):
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op2_language_id"](spark, DATA).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in rows} == set(lang) and 0.1 < len(held) / len(rows) < 0.3
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def parsed(text, texts):
    """Phrases of a text: the longest run from each place that some sample text holds."""
    n = at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and any(text[at : to + 1] in t for t in texts):
            to += 1
        n, at = n + 1, to
    return n


def test_automaton_parses_by_longest_matches():
    texts = [" abab abc ", " xabx ", " bca aa ab ", " abab abx "]
    own, r = SuffixAutomaton(texts), random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice(" abcxz") for _ in range(r.randint(0, 14)))
        assert own.phrases(t) == parsed(t, texts), t


def test_language_query_agrees_with_a_plain_parse(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sample = learn(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"), chars=3000)
    assert len(sample) == 4 and all(0.8 * 3000 < sum(map(len, v)) <= 3000 for v in sample.values())
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs, sample).collect()}
    langs, tried = sorted(sample), 0
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        own = f" {' '.join(words)} "
        if not any(map(str.isalpha, own)):
            assert got[r["doc_id"]] == ("und", 0.0)
        elif len(own) < 3000:
            cost = {k: parsed(own, sample[k]) * np.log2(2 + sum(map(len, sample[k]))) / len(own) for k in langs}
            first, second = sorted(langs, key=lambda k: (cost[k], k))[:2]
            assert got[r["doc_id"]] == (first, pytest.approx(1 - cost[first] / cost[second], abs=1e-12))
            tried += 1
    assert tried > 100


def test_equal_parses_go_to_the_first_language(spark):
    sample = {"b": [" one two "], "a": [" one two "]}
    assert identify(spark.createDataFrame([(1, "two")], "doc_id long, text string"), sample).first()[1:] == ("a", 0.0)


def test_every_language_is_learned(spark):
    copied = [(f"text{i} of{lang} word{i}{lang} " * 3, lang) for lang in map("c{}".format, range(8)) for i in range(5) for _ in range(800)]
    rows = [*copied, *((f"longest{i} " * 3000, "long") for i in range(3)), ("12 34", "none"), *((f"word{chr(97 + i % 26)}{chr(97 + i // 26)} again", f"m{i}") for i in range(70))]
    sample = learn(spark.createDataFrame(rows, "text string, lang string"))
    assert set(sample) == {lang for _, lang in rows} - {"none"}
    assert sample == learn(spark.createDataFrame(rows[::-1], "text string, lang string").repartition(5))
    assert len(sample["c3"]) == 5 and " text ofc word c " in sample["c3"][0] and set(" ".join(sample["long"]).split()) == {"longest"}
    assert all(t == running(t) for v in sample.values() for t in v)


def test_sample_is_the_texts_of_smallest_hash(spark):
    rows = [(f"w{''.join(chr(97 + int(c)) for c in str(i))}", "en") for i in range(5000)]
    df = spark.createDataFrame([r for r in rows for _ in range(3)], "text string, lang string")
    want = [f" {r['text']} " for r in df.distinct().orderBy(F.xxhash64("text")).limit(400).collect()]
    assert learn(df)["en"] == want
    assert learn(df, chars=50)["en"] == want[: len(learn(df, chars=50)["en"])] and sum(map(len, learn(df, chars=50)["en"])) <= 50


def test_languages_odd_rows(spark):
    seen = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    sample = learn(seen)
    assert sample == {"en": [" the cat and the dog "], "fr": [" le chat et le chien "]}
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 !?", "q"), (4, "the dog", "q"), (None, "le chien", "q"), (4, "the dog", "q"), (5, "chat " * 5000, "q")], "doc_id long, text string, score string")
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in identify(df, sample).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr"), (5, "fr")], key=str)
    assert identify(df.limit(0), sample).count() == 0 and learn(seen.limit(0)) == {}
    assert {r["lang_pred"] for r in identify(df, {}).collect()} == {"und"}


# --- neighbours ---
def exact(x, ids, q, k):
    s = (x * x[q]).sum(1)
    s[q] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbours_query(spark, sf):
    e = spark.read.parquet(f"{os.path.dirname(DATA)}/{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    place, found = {v: i for i, v in enumerate(ids)}, {}
    for r in sorted(QUERIES["op5_cross_polytope"](spark, f"{os.path.dirname(DATA)}/{sf}").collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(float(x[place[r["query_id"]]] @ x[place[r["vec_id"]]]), abs=1e-12)
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(found) == set(ids[queries])
    for v in found.values():
        assert [k for k, _, _ in v] == list(range(1, 21)) and [n[1:] for n in v] == sorted(n[1:] for n in v) and len({n for *_, n in v}) == 20
    assert np.mean([len(set(exact(x, ids, q, 20)) & {n for *_, n in found[ids[q]]}) / 20 for q in queries]) >= 0.9


def test_choice_of_tables_and_probes():
    near = np.array([[0, 9], [9, 0], [0, 0], [1, 9]] * 25)
    assert cheapest(near) == (2, 2)  # two tables with two probes reach all; one would need ten
    assert cheapest(np.array([[30, 40], [40, 30], [31, 60]] * 25)) == (1, 41)  # nothing is near: one table, many probes


@pytest.mark.parametrize("scale", [False, True])
def test_recall_through_the_tables(spark, scale):
    r = np.random.default_rng(4)
    x = r.normal(size=(6000, 48)) + 2.0 * r.normal(size=(10, 48))[r.integers(0, 10, 6000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= r.uniform(0.5, 2, (6000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for row in nearest(df, "vec_id % 100 = 0").collect():
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    assert np.mean([len(set(exact(x, np.arange(6000), q, 20)) & found[q]) / 20 for q in range(0, 6000, 100)]) >= 0.9


def unit(n, d, clusters=0):
    r = np.random.default_rng(7)
    x = r.normal(size=(n, d)) + (2.0 * r.normal(size=(clusters, d))[r.integers(0, clusters, n)] if clusters else 0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(spark, x, every=100, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for row in nearest(df, f"vec_id % {every} = 0", **how).collect():
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    return np.mean([len(set(exact(x, np.arange(len(x)), q, 20)) & found[q]) / 20 for q in range(0, len(x), every)])


@pytest.mark.parametrize("lengths", ["outlier", "lognormal"])
def test_recall_with_uneven_lengths(spark, lengths):
    x = unit(6000, 64)
    if lengths == "outlier":
        x[7] *= 3
    else:
        x *= np.exp(0.5 * np.random.default_rng(8).normal(size=(6000, 1)))
    assert recall(spark, x) >= 0.9


@pytest.mark.parametrize(("dims", "clusters"), [(128, 0), (384, 0), (768, 10)])
def test_recall_in_more_dimensions(spark, dims, clusters):
    assert recall(spark, unit(4500, dims, clusters)) >= 0.9


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (2, [1.0, 0.0]), (40, None), (60, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, nearest(df, "vec_id % 20 = 0", 2).collect()))
    assert got == [(0, 1, 2, 1.0), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 2, 1.0)]
    assert nearest(df.limit(0), "vec_id % 20 = 0").count() == 0 and nearest(df, "vec_id = 3").count() == 0
    assert {r["vec_id"] for r in nearest(df, "vec_id = 0", 20).collect()} == {1, 2, 20}


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(20, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    index = CrossPolytope(64, 2, 1.0, True)
    assert (index.probes(x, 1, 1)[:, 0] == index.buckets(x, 1)).all()


# --- conversations ---
CHAT = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "ok", "<|", "<\\|im_end|>", "\\", "<\\\\|", "|>", "é", " ", "user\n", "\\n", "<"]


def test_round_trips():
    r = random.Random(6)
    bits = lambda n: "".join(r.choice(CHAT) for _ in range(r.randint(0, n)))
    for _ in range(3000):
        turns = [(bits(3) if r.random() < 0.4 else "user", bits(6)) for _ in range(r.randint(0, 5))]
        formatted, places = round_trip(turns)
        assert parse(formatted) == turns and len(places) == len(turns)
    plain, _ = round_trip([("user", "hi <b>"), ("assistant", "yes")])
    assert plain == "<|im_start|>user\nhi <b><|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"


def test_very_many_conflicts_in_linear_time():
    hard = "<|im_end|><|im_start|>assistant ok <\\|im_end|>"
    turns = [("user\n" if i % 3 else "assistant", hard) for i in range(10_000)] + [("user", "x" * 1_000_000 + hard)]
    began = time.monotonic()
    formatted, places = round_trip(turns)
    assert time.monotonic() - began < 2 and parse(formatted) == turns and len(places) == len(turns)


def test_conversations_odd_rows(spark):
    rows = [(1, 2, "assistant", "b<|im_end|>"), (1, 1, "user", "a"), (1, None, "system", None), (2, 1, None, ""), (2, 1, None, ""), (None, 1, "assistant", "z" * 40_000), (3, 1, "assistant", "y"), (3, 1, "assistant", "x"), *[(None, 2, "user", "q")] * 2]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int, lone int")
    lone = sorted((r["n_turns"], r["formatted_chars"]) for r in digests(format_conversations(df)).where("conv_id is null").collect())
    assert lone == [(1, 29), (1, 29), (1, 40_033)]
    df = df.where("conv_id is not null or role = 'assistant'")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in digests(format_conversations(df)).collect()}
    sha = brute.sha
    assert got == {
        1: (3, sha("system\n\nuser\na\nassistant\nb<|im_end|>\n"), 11, sha("b<|im_end|>")), 2: (2, sha("\n\n\n\n"), 0, sha("")),
        None: (1, sha("assistant\n" + "z" * 40_000 + "\n"), 40_000, sha("z" * 40_000)), 3: (2, sha("assistant\nx\nassistant\ny\n"), 2, sha("xy")),
    }
    assert format_conversations(df.limit(0)).count() == 0
