"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of the model crosses into a white-space marker, a text's marked words are segmented independently: each
distinct marked word is encoded and decoded once, and its ids are joined back by position. The property is read
off the model; without it, or for texts that hold the marker itself, the library gets the whole text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, text_slices
from .common import ship

MARK = "▁"
_MARKED = re.compile(" +[^ ]*")


class Pieces:
    """Encodes and decodes with one model; made once in each Python worker."""

    _made: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        probe = "  a\t b  c "
        kept = sp.encode(probe, out_type=str)
        #: Marked words are independent: no piece goes on into a marker, and the model keeps white space as it is and adds one marker in front.
        self.apart = all(MARK not in x.lstrip(MARK) for x in names) and "".join(kept).replace("<0x09>", "\t").replace(MARK, " ") == " " + probe
        self.mark_id = np.array([sp.piece_to_id(MARK)], "<u4").tobytes()
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        self.table = ChunkTable(self._work)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _work(self, words: list[str]) -> list[tuple[bytes, str]]:
        # a marked word without its first marker: the library adds that itself, but to no empty text
        ids = self.sp.encode(words, num_threads=1)
        return [(array("I", i).tobytes(), d) if w else (self.mark_id, "") for w, i, d in zip(words, ids, self.sp.decode(ids, num_threads=1), strict=True)]

    def _cut(self, text: str) -> list[str] | None:
        """The marked words of a text, each without its first marker; None if they cannot be taken apart."""
        if not self.apart or MARK in text:
            return None
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [w[1:] for w in _MARKED.findall(" " + text)]
        return text.split(" ") if text else []

    def all(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Packed ids with begin and end, and their decoded text, of each text."""
        for a, b in text_slices(texts):
            chunked = [self._cut(t) for t in texts[a:b]]
            self.table.learn([c for c in chunked if c])
            for text, words in zip(texts[a:b], chunked, strict=True):
                if words is None:
                    ids = [self.sp.bos_id(), *self.sp.encode(text), self.sp.eos_id()]
                    yield array("I", ids).tobytes(), self.sp.decode(ids)
                elif words:
                    ids, decoded = zip(*map(self.table.__getitem__, words), strict=True)
                    yield b"".join((self.begin, *ids, self.end)), " ".join(decoded)
                else:
                    yield self.begin + self.end, ""


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded, and with ids=True the ids (array<int>) of each text, begin and end ids included.

    Null text counts as empty. Every row gives one row, whatever its id; other columns are not carried.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = list(pieces.all([t or "" for t in part.column(1).to_pylist()]))
                cols = [part.column(0), pa.array([len(f[0]) // 4 for f in found], pa.int64()), pa.array([hashlib.sha256(f[0]).hexdigest() for f in found]), pa.array([f[1] for f in found], pa.string())]
                if ids:
                    cols.append(pa.array([np.frombuffer(f[0], "<u4").astype(np.int32) for f in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded", "ids"][: len(cols)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded string" + (", ids array<int>" if ids else "")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
