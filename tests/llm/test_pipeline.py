import os
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from phrasewright.llm.common import materialise, released, shared_folder
from phrasewright.llm.quality_rules import quality_verdicts

from ..holding import DATA
from . import brute


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), "step")
        steps.append((docs.columns, {r["doc_id"]: r for r in docs.collect()} if "text" in docs.columns else docs.collect()))
    (c1, good), (c2, one), (c3, cut), (c4, masked), (_, packed) = steps
    assert c1 == c2 == c3 == c4 == list(before[0].asDict())
    kept = {r["doc_id"] for r in quality_verdicts(spark.read.parquet(f"{DATA}/documents.parquet")).where("kept").collect()}
    assert set(good) == kept and all(good[d] == before[d] for d in good) and not any(brute.quality_counts(r["text"])[-1] for r in good.values())
    near = brute.near([(d, r["text"]) for d, r in good.items()])
    assert set(one) == {d for d, (_, c) in near.items() if d == c}
    rest = brute.substring([(d, r["text"]) for d, r in one.items()])
    assert set(cut) == {d for d, (n, gone, _) in rest.items() if not gone or gone < n}
    for d, r in cut.items():
        assert brute.sha(" ".join(brute.WORD.findall(r["text"]))) == rest[d][2] and r["n_chars"] == len(r["text"])
        assert r["text"] == one[d]["text"] or rest[d][1]
    assert set(masked) == set(cut)
    for d, r in masked.items():
        spans = brute.secrets(cut[d]["text"])
        assert not brute.secrets(r["text"]) and (("[SECRET]" in r["text"]) if spans else (r["text"] == cut[d]["text"] or "[SECRET]" in r["text"]))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = brute.pieces([(d, r["text"]) for d, r in masked.items()], lambda t: tok.encode(t, add_special_tokens=False).ids, 2048)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed} == want


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 < out.count()


def written(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return {f for f in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_run_leaves_only_its_result_and_touches_no_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    other = materialise(docs.limit(3), "other")
    before = written(spark)
    out = corpus_pipeline.run(spark, DATA)
    assert len(written(spark) - before) == 1 and before <= written(spark) and out.count() > 0 and other.count() == 3
    with released(spark) as kept:
        mine = materialise(docs.limit(2), "mine")
        kept.append(materialise(docs.limit(1), "kept"))
        during = written(spark)
    assert written(spark) == {f for f in during if not f.startswith("mine")} and mine.__dict__["shared_path"].rsplit("/", 1)[1] in during


def test_stages_on_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    word = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, word("x"), "en", None), (3, word("x"), "en", None), (4, word("x"), "en", "b"), (None, word("y") + " token=abcdefgh12", None, "b"),
        (5, word("z") + " " + passage, "en", "a"), (6, passage + " " + word("q"), "en", "a"), (7, " ".join(np.base_repr(i, 36) for i in range(30_000)), "fr", "a"), (None, None, None, None),
    ]
    names = ["row", "q", "gone", "of", "marks", "rules", "spans", "secrets", "n_words", "part", "text2"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).withColumns({c: F.lit(c) for c in names})
    columns, empty = docs.columns, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = materialise(stage(spark, docs, DATA), "step"), materialise(stage(spark, empty, DATA), "step")
        assert sorted(docs.columns) == sorted(columns) and sorted(empty.columns) == sorted(columns) and empty.count() == 0, name
        assert all(r[c] == c for r in docs.collect() for c in names if c in docs.columns), name
    left = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert left == {(3, word("x")), (None, word("y") + " [SECRET]"), (5, rows[6][1]), (6, word("q")), (7, rows[8][1])} and docs.where("doc_id = 3").count() == 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("doc_id is null").count() == 1 and corpus_pipeline.STAGES[-1][1](spark, empty, DATA).count() == 0


def test_near_dedup_of_few_long_texts(spark):
    """Groups of three texts whose length spreads them over two blocks, of which one may stay empty."""
    r, rows = random.Random(9), []
    for i in range(8):
        w = [f"f{i}w{r.randrange(10**6)}" for _ in range(12_000)]
        rows += [(3 * i, " ".join(w[:9_000] + [f"f{i}o{k}" for k in range(3_000)])), (3 * i + 1, " ".join(w)), (3 * i + 2, " ".join(w[:11_760] + [f"f{i}n{k}" for k in range(240)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = dict(map(tuple, corpus_pipeline.near_dedup(spark, docs, DATA).collect()))
    assert out == {d: t for d, t in rows if d % 3 < 2}
