"""The same normalisers for one query string on the driver; tests hold them against the Column forms."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from .text import CONSONANTS, DROPPED_MARKS, DROPPED_POINTS, FOLDS, HALANT, LETTERS, LOWER, SIGNS, SPACE_CLASS, SPACES, STOP_WORDS, UPPER

_INHERENT = re.compile(f"([{''.join(CONSONANTS)}])(?![{''.join(SIGNS)}{HALANT}])")
_SPELL = str.maketrans({**dict(zip(UPPER, LOWER, strict=True)), **LETTERS})
_DROP = str.maketrans("", "", DROPPED_MARKS + DROPPED_POINTS)


def squeeze(s: str) -> str:
    return re.sub(f"{SPACE_CLASS}+", " ", s).strip(" ")


def fold(s: str) -> str:
    s = re.sub(f"[^a-z{SPACES}]", "", s.lower())
    for pattern, to in FOLDS:
        s = re.sub(pattern, to, s)
    return squeeze(re.sub(r"([a-z])\1+", r"\1", s))


def to_roman(s: str) -> str:
    s = re.sub(SPACE_CLASS, " ", _INHERENT.sub(r"\1a", unicodedata.normalize("NFC", s)))
    s = re.sub(f"[^a-zA-Z0-9 {''.join(LETTERS)}]", "", s).translate(_SPELL)
    return re.sub(" +", " ", s).strip(" ")


def norm_dev(s: str) -> str:
    return re.sub(f"{SPACE_CLASS}+", " ", unicodedata.normalize("NFC", s).translate(_DROP)).lower().strip(" ")


def ngrams(s: str, n: int) -> list[str]:
    return list(dict.fromkeys(s[i : i + n] for i in range(len(s) - n + 1)))


@dataclass(frozen=True)
class Query:
    """A parsed query: the side of the rows it is held against, the phrase, its tokens, and the length typed."""

    raw: str
    devanagari: bool
    phrase: str
    tokens: tuple[str, ...]

    @property
    def blank(self) -> bool:
        return not self.raw

    @property
    def several(self) -> bool:
        return " " in self.phrase

    @property
    def typed(self) -> int:
        """UTF-16 units of the trimmed query."""
        return len(self.raw.encode("utf-16-le")) // 2


def parse_query(text: str | None) -> Query:
    raw = (text or "").strip(SPACES)
    dev = re.search("[ऀ-ॿ]", raw) is not None
    phrase = norm_dev(raw) if dev else fold(raw)
    tokens = [t for t in phrase.split(" ") if t]
    if not dev and len(tokens) > 1:
        tokens = [t for t in tokens if t not in STOP_WORDS] or tokens
    return Query(raw, dev, phrase, tuple(tokens))
