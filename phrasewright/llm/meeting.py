"""Where equal hashes of different documents meet: a packed, combining exchange.

Mappers hand in (hash, document) entries. Within a mapper's slice, equal hashes are combined: one
entry, that of the smallest document, goes on to the hash's bucket, and what is already known of the
others is passed through, spread over all buckets by document. A hash that a third of all documents
hold therefore sends one entry from each slice, never one from each document, and nothing is paired.
Entries travel as packed arrays, so that JVM and Python see thousands of entries a row.

mode any:   documents whose hash some other document holds too
mode later: documents whose hash a smaller document holds
mode star:  pairs (smallest document of the group, other document)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions, plan_bytes
from .wordhash import U, mix

SENT = "bucket int, kind int, h binary, doc binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("doc", pa.binary())])
#: Text (as its files hold it) whose entries a bucket takes; a bucket is one step of a task.
BUCKET_BYTES = 16 << 20
REPLY = {"any": "doc_id long, h binary", "later": "doc_id long, h binary", "star": "a long, b long"}


def bucket_count(texts: DataFrame) -> int:
    """Buckets for the entries of some texts: a few for each shuffle partition, and as many as it takes for each to hold those of about
    BUCKET_BYTES of text."""
    size = plan_bytes(texts)
    return max(4 * max(16, partitions(texts.sparkSession)), size // BUCKET_BYTES if size < 1 << 60 else 0)


def _groups(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by hash, then document, without repeats; the start of each group and the group of each entry."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return h, doc, np.flatnonzero(new), np.cumsum(new) - 1


def _known(mode: str, h: np.ndarray, doc: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the groups at hand show by themselves: (hash, document), or (smallest, document) for stars."""
    size = np.diff(np.append(start, len(h)))[group]
    later = np.ones(len(h), bool)
    later[start] = False
    if mode == "any":
        hit = size > 1
        return h[hit], doc[hit]
    if mode == "later":
        return h[later], doc[later]
    return doc[start][group][later].astype(U), doc[later]


def _split(bucket: np.ndarray, kind: int, h: np.ndarray, doc: np.ndarray, wide: bool) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, h, doc = bucket[order], h[order], doc[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(bucket)])), strict=True):
        if b > a:
            yield int(bucket[a]), kind, (h[a:b] if wide else h[a:b].astype(np.uint32)).tobytes(), doc[a:b].tobytes()


def send(h: np.ndarray, doc: np.ndarray, n_buckets: int, mode: str, wide: bool) -> pa.RecordBatch:
    """A slice's entries, combined and packed by bucket. Narrow entries keep 32 bits besides their bucket's; use them for filters only."""
    h, doc, start, group = _groups(h, doc)
    rows = []
    if len(h):
        sent = h[start]
        rows += _split(((sent >> U(32)) % U(n_buckets)).astype(np.int32), 0, sent, doc[start], wide)
        kh, kd = _known(mode, h, doc, start, group)
        if len(kh):
            rows += _split((mix(kd.astype(U)) % U(n_buckets)).astype(np.int32), 1, kh, kd, wide or mode == "star")
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SENT_ARROW, strict=True)], schema=SENT_ARROW)


def _reply(mode: str, h: np.ndarray, doc: np.ndarray, wide: bool) -> pa.RecordBatch:
    if mode == "star":
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(doc)], names=["a", "b"])
    order = np.argsort(doc, kind="stable")
    h, doc = (h if wide else h.astype(np.uint32))[order], doc[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
    return pa.RecordBatch.from_arrays([pa.array(doc[cut[:-1]]), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "h"])


def meet(sent: DataFrame, mode: str, wide: bool) -> DataFrame:
    """Bring the entries of each bucket together, one bucket in memory at a time, and reply to their documents."""
    kind_h = np.uint64 if wide else np.uint32

    def answer(known: list, entries: list) -> Iterator[pa.RecordBatch]:
        found = []
        if known:
            found.append((np.concatenate([np.frombuffer(a, np.uint64 if mode == "star" else kind_h) for a, _ in known]).astype(U), np.concatenate([np.frombuffer(b, np.int64) for _, b in known])))
        if entries:
            h, doc, start, group = _groups(np.concatenate([np.frombuffer(a, kind_h) for a, _ in entries]).astype(U), np.concatenate([np.frombuffer(b, np.int64) for _, b in entries]))
            found.append(_known(mode, h, doc, start, group))
        if found:
            h, doc, _, _ = _groups(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            if len(h):
                yield _reply(mode, h, doc, wide)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, entries = None, [], []
        for batch in batches:
            for bucket, kind, h, doc in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != at:
                    yield from answer(known, entries)
                    at, known, entries = bucket, [], []
                (known if kind else entries).append((h, doc))
        yield from answer(known, entries)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, REPLY[mode])
