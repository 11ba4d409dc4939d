"""Chat formatting with a grammar round trip.

A conversation is rendered as  <|im_start|>role NEWLINE text <|im_end|> NEWLINE  for each turn. The rendered string is
parsed again by a deterministic parser; where a recovered turn differs from its source, that turn's content is escaped,
until the parse gives back the source. In a text, an escape is a backslash between < and |: writing adds one after < where
only backslashes stand before |, reading takes one away, so texts that hold escapes themselves come back too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(re.escape(START) + "|" + re.escape(END))
_TO_ESCAPE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPES = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_READS = {"\\": "\\", "n": "\n", "l": "<"}


def _role(role: str, escaped: bool) -> str:
    return "".join(_ROLE_ESCAPES.get(c, c) for c in role) if escaped else role


def _read_role(role: str) -> str:
    return re.sub(r"\\([\\nl])", lambda m: _ROLE_READS[m[1]], role)


def render(turns: list[tuple[str, str]], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The string of the turns, those in `escaped` with their content escaped, and each text's place in it."""
    parts, places, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head = f"{START}{_role(role, i in escaped)}\n"
        body = _TO_ESCAPE.sub(r"<\\\1|", text) if i in escaped else text
        parts += [head, body, END, "\n"]
        places.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), places


def _read_turn(formatted: str, at: int) -> tuple[tuple[str, str] | None, int]:
    """The turn that begins at a place, and where the next one does; -1 where the string does not go on as the grammar wants."""
    if not formatted.startswith(START, at):
        return None, -1
    line = formatted.find("\n", at)
    stop = _CONTROL.search(formatted, line + 1) if line >= 0 else None
    if stop is None:
        return None, -1
    turn = _read_role(formatted[at + len(START) : line]), _ESCAPED.sub(r"<\1|", formatted[line + 1 : stop.start()])
    return turn, stop.end() + 1 if stop[0] == END and formatted.startswith("\n", stop.end()) else -1


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered string as far as it follows the grammar: what is read of the first turn that does not is the last."""
    turns, at = [], 0
    while 0 <= at < len(formatted):
        turn, at = _read_turn(formatted, at)
        if turn is None:
            break
        turns.append(turn)
    return turns


def round_trip(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Render, parse and compare; escape the turns that do not come back, until all do.

    Each turn is parsed from its own place, so one pass finds every conflict, whatever a turn before it would make of the parse; the
    string that is returned has come back whole.
    """
    escaped: set[int] = set()
    while True:
        formatted, places = render(turns, escaped)
        if parse(formatted) == turns:
            return formatted, places
        begins = [0, *(stop + len(END) + 1 for _, stop in places)]
        wrong = {i for i, turn in enumerate(turns) if _read_turn(formatted, begins[i]) != (turn, begins[i + 1])}
        if not wrong or wrong <= escaped:
            raise ValueError("content that cannot be escaped")
        escaped |= wrong


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_on: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_mask (places of the texts to train on, as pairs in code points, end exclusive).

    Rows are put in the order of turn, then role, then text, nulls first; null role and text count as empty; repeated rows are
    repeated turns. A row without a conversation id is a conversation of its own, so that any number of them can be dealt out. A
    conversation is one training sample and must fit in a task's memory. Other columns play no part. No rows give no rows.
    """
    ship(df.sparkSession)
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    lone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("lone")
    rows = df.select(F.col(conv_col).alias("conv_id"), lone, turn.alias("turn"))
    grouped = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    texts = grouped.select("conv_id", F.transform("turns", lambda t: F.coalesce(t["role"], F.lit(""))).alias("roles"), F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for roles, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = list(zip(roles, own, strict=True))
                formatted, places = round_trip(turns)
                done.append((formatted, [list(p) for p, (role, _) in zip(places, turns, strict=True) if role == train_on]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.list_(pa.int64())))], names=["conv_id", "formatted", "loss_mask"])

    schema = f"conv_id {df.schema[conv_col].dataType.simpleString()}, formatted string, loss_mask array<array<long>>"
    return texts.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from format_conversations(): counts and digests of turns and of the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(_ESCAPED.sub(r"<\1|", text[a:b]) for a, b in mask)
                out.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
