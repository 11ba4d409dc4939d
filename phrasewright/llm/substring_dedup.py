"""Removal of passages that another, earlier document already holds.

Difference-cover anchors. Positions i with i mod 7 in {1, 2, 4} form a difference cover: whatever the
distance between two equal windows of 13 words, some offset below 7 puts an anchor position into both.
So only runs of 7 words at cover positions are hashed and exchanged (3 of 7 positions), and any two equal
13-word windows share an aligned anchor. Anchors found in two documents are then extended: the 13-word
windows around them, and only those, meet again on full hashes to find the smallest document of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, ship
from .meeting import SENT, bucket_count, meet, send
from .wordhash import U, Words, buffers, mix, runs, slices

WINDOW, PERIOD = 13, 7
ADDED = ("n_words", "n_removed", "n_windows")


def difference_cover(period: int) -> tuple[int, ...]:
    """The smallest set of residues whose differences reach every residue."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            own = (0, *rest)
            if len({(a - b) % period for a in own for b in own}) == period:
                return own
    return (0,)


def _anchors(words: Words, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    at, h = words.windows(window - period + 1)
    own = np.isin((at - words.first[words.doc[at]]) % period, cover)
    return at[own], h[own]


def _marked(doc: np.ndarray, h: np.ndarray, marks: list, kind: type) -> np.ndarray:
    """Which (text, hash) are among the hashes listed for that text."""
    lists = [np.frombuffer(b"".join(m), kind).astype(U) if m else np.zeros(0, U) for m in marks]
    salt = lambda d: mix(d.astype(U) + U(1))
    known = np.unique(np.concatenate([x ^ salt(np.full(len(x), i)) for i, x in enumerate(lists)] or [np.zeros(0, U)]))
    return np.isin(h.astype(kind).astype(U) ^ salt(doc), known)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, joined: bool = False, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document with a smaller id.

    Words are runs of characters other than space and tab to carriage return; windows are judged on the input.
    Returns every input row with its columns (the text replaced) plus n_words, n_removed and n_windows, the number
    of windows removed (or as they are named by `added`). The text that is left keeps its own white space; with joined=True it is the kept words
    joined by one space. A text of which nothing is removed stays as it is unless joined.

    Null text has no words and comes back null ("" if joined). A row without id matches nothing and loses nothing.
    Rows that repeat an id are one document: none takes words from another. Other columns may have any names; one named
    like an added column gives way to it.
    """
    if not 1 <= period <= window:
        raise ValueError("period must lie between 1 and window")
    spark = df.sparkSession
    ship(spark)
    cover = difference_cover(period)
    # the input's columns go through as they are, so that both joins below share one exchange of the texts
    docs = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in {a.lower() for a in added}))
    if df.schema[id_col].dataType.simpleString() != "bigint":
        docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    known, n = docs.where(F.col(id_col).isNotNull()), bucket_count(docs.select(id_col, text_col))
    of, own_marks = fresh([*docs.columns, *added], "of", "marks")
    i_id, i_text, i_marks = docs.columns.index(id_col), docs.columns.index(text_col), len(docs.columns)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, words, _ in runs(batch, text_col, most=2 << 20):
                at, h = _anchors(words, window, period, cover)
                yield send(h, ids[a + words.doc[at]], n, "any", False)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(i_marks).is_valid())
            ids, marks = batch.column(i_id).to_numpy(), batch.column(i_marks)
            for a, b, words, _ in runs(batch, text_col, most=2 << 20):
                at, h = _anchors(words, window, period, cover)
                at = at[_marked(words.doc[at], h, marks[a:b].to_pylist(), np.uint32)]
                near = np.zeros(len(words.hash) + 1, np.int32)
                np.add.at(near, np.maximum(at - period + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                start, full = words.windows(window)
                own = np.cumsum(near)[start] > 0
                yield send(full[own], ids[a + words.doc[start[own]]], n, "later", True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(i_text))
            missing = batch.column(i_text).is_null().to_pylist()
            marks = batch.column(i_marks)
            for a, b in slices(offs):
                block, rel = raw[offs[a] : offs[b]].tobytes(), offs[a : b + 1] - offs[a]
                hit = [i for i in range(b - a) if marks[a + i].is_valid]
                gone = {}
                if hit:
                    size = np.concatenate(([0], np.cumsum([rel[i + 1] - rel[i] for i in hit])))
                    words = Words(np.frombuffer(b"".join(block[rel[i] : rel[i + 1]] for i in hit), np.uint8), size)
                    start, full = words.windows(window)
                    start = start[_marked(words.doc[start], full, [marks[a + i].as_py() for i in hit], np.uint64)]
                    over = np.zeros(len(words.hash) + 1, np.int32)
                    np.add.at(over, start, 1)
                    np.add.at(over, start + window, -1)
                    over, per = np.cumsum(over)[:-1] > 0, np.bincount(words.doc[start], minlength=len(hit))
                    for k, i in enumerate(hit):
                        own = slice(words.first[k], words.first[k + 1])
                        gone[i] = over[own], words.start[own] - size[k], int(per[k])
                out = []
                for i in range(b - a):
                    text = block[rel[i] : rel[i + 1]]
                    split = text.split()
                    lost, starts, windows = gone.get(i, (None, None, 0))
                    n_lost = int(lost.sum()) if lost is not None else 0
                    if joined:
                        text = b" ".join(w for w, x in zip(split, lost, strict=True) if not x) if n_lost else b" ".join(split)
                    elif n_lost:
                        turn = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0]))))
                        ends, at, kept = np.append(starts, len(text)), 0, []
                        for x, y in turn.reshape(-1, 2):
                            kept.append(text[at : ends[x]])
                            at = ends[y]
                        text = b"".join([*kept, text[at:]])
                    out.append((None if missing[a + i] and not joined else text.decode("utf-8"), len(split), n_lost, windows))
                texts, words_n, lost_n, windows_n = zip(*out, strict=True)
                own = [pa.array(texts, pa.string()) if i == i_text else batch.column(i)[a:b] for i in range(i_marks)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in (words_n, lost_n, windows_n))], names=names)

    names = [*docs.columns, *added]
    shown = [F.col(f"`{c}`") for c in docs.columns]
    by_doc = lambda replies: replies.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list("h").alias(own_marks))
    marked = lambda replies: known.join(by_doc(replies), F.col(id_col) == F.col(of), "left").select(*shown, own_marks)
    shared = meet(known.select(id_col, text_col).mapInArrow(anchors, SENT), "any", False)
    later = meet(marked(shared).mapInArrow(extended, SENT), "later", True)
    lone = docs.where(F.col(id_col).isNull()).withColumn(own_marks, F.lit(None).cast("array<binary>"))
    schema = StructType(list(docs.schema.fields))
    for c in added:
        schema = schema.add(c, "long")
    done = marked(later).unionByName(lone).mapInArrow(cut, schema)
    return done.withColumn(id_col, F.col(id_col).cast(df.schema[id_col].dataType)) if docs.schema[id_col].dataType != df.schema[id_col].dataType else done
