import hashlib
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from phrasewright.llm.common import materialise
from phrasewright.llm.packing import WEIGHTS, ByteBpe, best_fit, pack, pack_documents, tightest
from phrasewright.llm.queries import QUERIES
from phrasewright.llm.sentence_pieces import Pieces, encode_decode
from phrasewright.llm.token_counts import PrefixCounts, count_tokens

from ..holding import DATA
from . import brute

BPE, WORDS, MODEL = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [
    " ", "  ", "\n", "\t", "a", "the", "▁", "é", "日本", "\x00", "<s>", "<|endoftext|>", "\x85", "'s", "'re", "1", ",", "\xa0", "İ", "🙂", "\r\n", " b", "﻿", "é", "THE", "tion", "...", "ß", "²", "_", "Ǆ", "<|", "١", "ﬁ",
]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 10))) for _ in range(n)]


def sp_ids(sp, t):
    return [sp.bos_id(), *sp.encode(t), sp.eos_id()]


def test_packing_query(spark, docs):
    tok = Tokenizer.from_file(BPE)
    rows = QUERIES["op1_best_fit_packing"](spark, DATA).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == brute.pieces(docs, lambda t: tok.encode(t, add_special_tokens=False).ids, 2048)
    packed = {}
    for r in rows:
        packed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in packed.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(packed) <= 1.02 * np.ceil(sum(r["length"] for r in rows) / 2048) + 1


def test_byte_ids_agree_with_the_library():
    tok, own = Tokenizer.from_file(BPE), ByteBpe.of(BPE)
    assert own.fast is not None
    for t in texts(3000, 1):
        assert own.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    r = np.random.default_rng(3)
    size = np.sort(r.integers(1, 101, 500))[::-1]
    need = np.stack([size, np.ones(500, int), size * size], 1)
    cap = np.array([100, 4, 6000 + 4001])
    place, offset = best_fit(need, cap, np.array([1.0, 0.1, 0.1]), rule)
    for b in range(place.max() + 1):
        own = place == b
        assert own.any() and (need[own].sum(0) <= cap).all()
        assert sorted(offset[own]) == [0, *np.cumsum(size[own][np.argsort(offset[own])])[:-1]]
    with pytest.raises(ValueError):
        best_fit(need, np.array([50, 4, 10_000]), np.ones(3))


def test_best_fit_fills():
    place, _ = best_fit(np.array([[6, 1], [5, 1], [5, 1], [4, 1]]), np.array([10, 9]), np.array([1.0, 0.0]))
    assert list(place) == [0, 1, 1, 0]


def test_packing_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", "x"), (3, "word " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = pack_documents(df, BPE, 512).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got if r["doc_id"] != 3) == [(0, 3), (1, 1), (2, 1), (2, 1)]
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 3)
    assert long[0][2] < 512 and all(n == 512 for _, _, n in long[1:]) and [s for _, s, _ in long[1:]] == [long[0][2] + 512 * i for i in range(len(long) - 1)]
    assert pack_documents(df.limit(0), BPE).count() == 0


def test_packing_under_several_constraints(spark):
    pieces = materialise(spark.createDataFrame([(i, 0, 0, 1 + i % 50, 0) for i in range(400)], "doc_id long, piece int, start long, length long, ids_crc32 long"), "t")
    by = {}
    for r in pack(pieces, 100, 5, 3000).collect():
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert sum(map(len, by.values())) == 400 and all(sum(v) <= 100 and len(v) <= 5 and sum(n * n for n in v) <= 3000 for v in by.values())


def test_other_dimensions_bear_on_the_query(spark, docs):
    tok, capacity = Tokenizer.from_file(BPE), np.array([2048, 2048, 2048 * 2048])
    size = np.sort([n for _, n, _ in brute.pieces(docs, lambda t: tok.encode(t, add_special_tokens=False).ids, 2048).values()])[::-1]
    need = np.stack([size, np.ones_like(size), size * size], 1)
    alone, together = best_fit(need, capacity, np.array([1.0, 0, 0]))[0], best_fit(need, capacity, np.array(WEIGHTS))[0]
    assert (alone != together).any() and alone.max() == together.max()  # other sequences are chosen, and no more of them
    # documents bind where that costs nothing: short pieces are spread over the sequences with room
    size = np.array([1000] * 10 + [1] * 100)
    need = np.stack([size, np.ones_like(size), size * size], 1)
    most = [np.bincount(f(need, capacity, np.array(WEIGHTS), "norm", *more)[0]).max() for f, more in ((best_fit, ()), (tightest, (1,)))]
    assert most[0] > 40 and most[1] < 30 and tightest(need, capacity, np.array(WEIGHTS), "norm", 1)[0].max() == 4
    assert len(tightest(need[:0], capacity, np.array(WEIGHTS), "norm", 1)[0]) == 0


def test_repeats_and_rows_without_id_are_dealt_to_all_groups(spark, monkeypatch):
    monkeypatch.setattr("phrasewright.llm.packing.GROUP_PIECES", 50)
    rows = [(7, 0, 0, 30, 1)] * 300 + [(None, 0, 0, 20, 1)] * 300
    pieces = materialise(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, part long"), "t")
    out = pack(pieces, 100, 100, 10_000)
    by = {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["part"]))
    assert out.columns == [*pieces.columns, "sequence_id", "offset"] and sum(map(len, by.values())) == 600 and all(x[2] == 1 for v in by.values() for x in v)
    assert all(sum(n for _, n, _ in v) <= 100 for v in by.values()) and max(Counter(s >> 32 for s, v in by.items() for _ in v).values()) < 120


def test_pieces_query(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for d, t in docs:
        ids = sp_ids(sp, t or "")
        want[d] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(sp.decode(ids))
    assert {r[0]: (r[1], r[2], r[3]) for r in QUERIES["op3_sentencepiece"](spark, DATA).collect()} == want


def test_pieces_agree_with_the_library():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), Pieces.of(MODEL)
    assert own.apart
    all_texts = [*texts(3000, 2), "x" * 50_000, "  lead", "trail  ", " ", ""]
    for t, (ids, decoded) in zip(all_texts, own.all(all_texts), strict=True):
        assert (ids, decoded) == (np.array(sp_ids(sp, t), "<u4").tobytes(), sp.decode(sp_ids(sp, t))), t


def test_pieces_of_long_texts_in_other_scripts():
    sp, own, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), Pieces.of(MODEL), random.Random(4)
    long = ["".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(100_000)), "नमस्ते दुनिया " * 8000, "สวัสดีครับ" * 10_000, "привет мир, " * 9000]
    for t, (ids, decoded) in zip(long, own.all(long), strict=True):
        assert (ids, decoded) == (np.array(sp_ids(sp, t), "<u4").tobytes(), sp.decode(sp_ids(sp, t))), t[:20]


def test_pieces_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "a  b", 1)], "doc_id long, text string, ids int")
    assert sorted(((r["doc_id"], r["n_tokens"], r["decoded"]) for r in encode_decode(df, MODEL).collect()), key=str) == [(1, 2, ""), (1, 2, ""), (2, 5, "a  b"), (None, 2, "")]
    assert encode_decode(df.limit(0), MODEL).count() == 0


def test_counts_query(spark, docs):
    tok = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r for r in QUERIES["op6_token_counts"](spark, DATA).collect()}
    for d, t in docs:
        n, r = len(tok.encode(t or "", add_special_tokens=False).ids), got[d]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 2048)


def test_every_prefix_count_is_exact():
    tok, own = Tokenizer.from_file(WORDS), PrefixCounts.of(WORDS)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for t in [*texts(800, 5), "Internationalization of antidisestablishmentarianism", "thththththaaaaaaaaing'll"]:
        want = [count(t[:i]) for i in range(len(t) + 1)]
        assert list(own.counts([t])) == want[-1:], t
        assert list(own.prefix_counts(t)) == want, t
        for budget in (0, 1, 2, 5):
            assert own.fitting(t, budget) == max(i for i, n in enumerate(want) if n <= budget), (t, budget)
            assert list(own.measure(["x", t, "", t], budget))[1::2] == [(want[-1], own.fitting(t, budget))] * 2


def test_long_texts_in_any_script_are_counted_once():
    tok, own = Tokenizer.from_file(WORDS), PrefixCounts.of(WORDS)
    r = random.Random(9)
    long = [
        "".join(chr(r.randint(0x3042, 0x3093)) if r.random() < 0.97 else "。" for _ in range(20_000)), "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(20_000)), "สวัสดีครับผมชื่อที่นี่" * 900, "नमस्ते दुनिया\xa0" * 1400,
        "plain words, " * 1500 + "one\xa0space " + "and more " * 1500, "naïve\xa0cafe\u0301's" * 1500, "ab" * 10_000, "한국어텍스트" * 3000, "x<|endoftext|>日本" * 1200,
    ]
    for t in ("o're\u0301x", "='ve\u0323", "\xa0'\u0301s\xa0\xa0a", "กี่'ll", "e\u0323\u0301<|endoftext|>\u0338"):
        assert list(own.prefix_counts(t)) == [len(tok.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t
    began = time.monotonic()
    found = list(own.measure(long, 2048))
    assert time.monotonic() - began < 60
    for t, (n, fit) in zip(long, found, strict=True):
        assert n == len(tok.encode(t, add_special_tokens=False).ids)
        prefixes = own.prefix_counts(t)
        assert prefixes[-1] == n and fit == np.flatnonzero(prefixes <= 2048)[-1]
        for i in [*range(40), *r.sample(range(len(t)), 40), fit, min(fit + 1, len(t))]:
            assert prefixes[i] == len(tok.encode(t[:i], add_special_tokens=False).ids), (t[:20], i)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    tok = Tokenizer.from_file(WORDS)
    monkeypatch.setattr("phrasewright.llm.token_counts.hash_runs", lambda raw, start: np.zeros(len(start), np.uint64))
    for t in ("the internationalization of it, 12 times", "same same"):
        assert list(PrefixCounts(WORDS).counts([t])) == [len(tok.encode(t, add_special_tokens=False).ids)]


def test_counts_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "word " * 3000, 1), (2, "word " * 3000, 1)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, count_tokens(df, WORDS, 2048).collect()), key=str)
    assert got == [(1, 0, 0, False, 0), (2, 15_000, 3000, True, 2048 * 5), (2, 15_000, 3000, True, 2048 * 5), (None, 0, 0, False, 0)]
    assert count_tokens(df.limit(0), WORDS, 5).count() == 0
