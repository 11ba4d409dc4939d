"""Vector best-fit packing of tokenized documents into training sequences.

A sequence has several capacities at once: tokens, documents, and attention cost (the sum of squared piece lengths).
Pieces are placed largest first; among the open sequences that have room in every dimension, the one chosen either
leaves the smallest weighted norm of what remains, or has the largest weighted dot product of demand and room.
Pieces are dealt into groups by hash, so that each group fits one task whatever the corpus; a group costs at most a
few sequences that are not full.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, materialise, ship, tasks_for
from .token_counts import byte_letters

GROUP_PIECES = 8192
#: What tokens, documents and attention cost count in the choice of a sequence. Tokens decide unless sequences are about equally full.
WEIGHTS = (1.0, 0.05, 0.05)
#: Fixed value: how byte-level tokenizers of this family cut text before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0]|[^\x00-\u024f]")


class ByteBpe:
    """Token ids of texts by a byte-level tokenizer file, as packed little-endian unsigned 32-bit integers.

    Where the file's merges stand in the order of their ids, its vocabulary is also a table of ranks, with which
    tiktoken gives the same ids several times faster; texts on which the two libraries could differ (characters whose
    class depends on the Unicode version, unusual white space) are given to tokenizers itself.
    """

    _made: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made == sorted(made) and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None:
            import tiktoken

            byte = {letter: b for b, letter in byte_letters().items()}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
            self.fast = tiktoken.Encoding("from-file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text: str) -> bytes:
        if self.fast is None or _UNSURE.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def token_pieces(df: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut from its end into pieces of `capacity`.

    Only texts of more tokens are cut, and only the first of their pieces may be shorter. Null text counts as empty.
    """
    ship(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBpe.of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "") + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity)
                    rows.append((doc, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, piece = to, piece + 1
            yield pa.RecordBatch.from_pylist([dict(zip(schema_names, r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    schema_names = schema.names
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(demands: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Place each row of demands (already in order) into a bin; returns bin numbers and the first dimension's offsets.

    rule "norm": the least weighted norm of the room that remains; rule "dot": the largest weighted dot product of
    demand and room. Ties go to the older bin. Bins without room in the first dimension are not looked at again.
    """
    if (demands > capacity).any():
        raise ValueError("an item exceeds a capacity by itself")
    scale = weights / capacity.astype(float) ** 2
    n, dims = demands.shape
    room, number = np.zeros((64, dims), np.int64), np.zeros(64, np.int64)
    used, bins = 0, 0
    place, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        need = demands[i]
        own = room[:used]
        fits = np.flatnonzero(own[:, 0] >= need[0])
        if len(fits):
            fits = fits[(own[fits, 1:] >= need[1:]).all(1)]
        if len(fits):
            left = own[fits] - need
            score = (left * left) @ scale if rule == "norm" else -(own[fits] * need) @ scale
            best = score.min()
            tied = fits[score == best]
            k = tied[np.argmin(number[tied])]
        else:
            if used == len(room):
                room, number = np.concatenate((room, np.zeros_like(room))), np.concatenate((number, np.zeros_like(number)))
            k = used
            room[k], number[k] = capacity, bins
            used, bins = used + 1, bins + 1
        place[i], offset[i] = number[k], capacity[0] - room[k, 0]
        room[k] -= need
        if room[k, 0] == 0:
            used -= 1
            room[k], number[k] = room[used], number[used]
    return place, offset


def tightest(demands: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """best_fit(), with the capacity of one dimension lowered step by step below what the fullest bin uses of it, as long as that takes no
    more bins than the capacity given."""
    best = best_fit(demands, capacity, weights, rule)
    bins, least = best[0].max(initial=-1) + 1, demands[:, dimension].max(initial=0)
    while bins:
        used = int(np.bincount(best[0], weights=demands[:, dimension]).max())
        capacity = capacity.copy()
        capacity[dimension] = min(used - 1, used * 7 // 8)
        if capacity[dimension] < least or bins * capacity[dimension] < demands[:, dimension].sum():
            break  # no packing into so many bins can keep this one
        found = best_fit(demands, capacity, weights, rule)
        if found[0].max(initial=-1) + 1 > bins:
            break
        best = found
    return best


def pack(pieces: DataFrame, capacity: int, max_documents: int, max_attention: int, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", even: bool = False) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...): no sequence exceeds `capacity` tokens, max_documents
    pieces or max_attention attention cost, and offsets are gapless from 0 in each sequence. even=True spreads pieces further: in each
    group the most pieces a sequence holds is lowered as long as that costs the group no sequence.

    Rows without id take part like others; repeated rows are packed each, dealt into any groups; no rows give no rows. A piece beyond
    a capacity by itself is an error. `pieces` is read twice, so hand in a written table.
    """
    ship(pieces.sparkSession)
    n = pieces.count()
    groups = max(1, math.ceil(n / GROUP_PIECES))
    cap, weight = np.array([capacity, max_documents, max_attention], np.int64), np.array(weights)
    (part,) = fresh(pieces.columns, "part")

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        size = rows["length"].to_numpy()
        demands = np.stack([size, np.ones_like(size), size * size], 1)
        place, offset = tightest(demands, cap, weight, rule, 1) if even else best_fit(demands, cap, weight, rule)
        return rows.assign(sequence_id=key[0] * (1 << 32) + place, offset=offset).drop(columns=part)

    schema = StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long")
    # a row's place in the written table is part of the hash: repeats of a row, and rows without id, go to all groups
    dealt = pieces.withColumn(part, F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy(part).applyInPandas(fill, schema)


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    The capacities are `capacity` tokens, the fewest documents a sequence that cost no sequence, and the attention cost of one full piece,
    which bears on the choice of a sequence only (squares add up to less than the squared sum). Null text is empty: one piece of
    the end id. Rows without id and repeated rows are pieces like others; of equal lengths the smaller doc_id and piece go first.
    """
    tasks = tasks_for(df)
    pieces = materialise(token_pieces(df, tokenizer, capacity, id_col, text_col), "pieces", tasks)
    return pack(pieces, capacity, capacity, capacity * capacity, even=True).coalesce(tasks)
