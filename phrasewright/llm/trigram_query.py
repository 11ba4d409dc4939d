"""Boolean trigram queries from regular expressions.

Every text that matches the expression holds, in lower case, all trigrams of at least one of the query's sets. A query
is a list of sets (any set, all of its trigrams); None stands for an expression that requires no trigram.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

MOST_STRINGS = 16
Query = list[frozenset[str]] | None


def _lower(code: int) -> str:
    return chr(code).lower()


def _class(items: list) -> list[str] | None:
    """The lower-cased characters of a small class."""
    chars: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(_lower(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_STRINGS:
            chars.update(_lower(c) for c in range(value[0], value[1] + 1))
        else:
            return None
    return sorted(chars) if len(chars) <= 8 else None


def _trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _read(parsed) -> list[tuple[frozenset[str], str, bool]]:
    """Alternatives of (trigrams met so far, literal text that ends here, whether that is the whole match)."""
    ways = [(frozenset(), "", True)]

    def cut(ways):
        return list(dict.fromkeys((grams | _trigrams(tail), "", False) for grams, tail, _ in ways))

    def append(ways, strings):
        out = list(dict.fromkeys((grams, tail + s, whole) for grams, tail, whole in ways for s in strings))
        return out if len(out) <= MOST_STRINGS * 4 else cut(ways)

    for kind, value in parsed:
        if kind is op.LITERAL:
            ways = append(ways, [_lower(value)])
        elif kind is op.IN:
            chars = _class(value)
            ways = append(ways, chars) if chars else cut(ways)
        elif kind in (op.SUBPATTERN, op.BRANCH):
            parts = [_read(value[-1])] if kind is op.SUBPATTERN else [_read(x) for x in value[1]]
            inner = [w for p in parts for w in p]
            joined = []
            for grams, tail, whole in ways:
                for g, t, w in inner:
                    joined.append((grams | g, tail + t, whole) if w else (grams | g | _trigrams(tail), t, False))
            ways = list(dict.fromkeys(joined)) if len(joined) <= MOST_STRINGS * 4 else cut(ways)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            inner = _read(body)
            if low == 0 and high == 1 and all(w for _, _, w in inner):
                ways = list(dict.fromkeys([*ways, *append(ways, [t for _, t, _ in inner])]))
            else:
                if low:
                    ways = [(g | grams | _trigrams(tail), "", False) for grams, tail, _ in ways for g in {h | _trigrams(t) for h, t, _ in inner}]
                ways = cut(ways)
        elif kind is not op.AT:
            ways = cut(ways)
    return ways


def trigram_query(pattern: str) -> Query:
    """The query of a pattern, or None if some way to match it has no mandatory trigram."""
    sets = {grams | _trigrams(tail) for grams, tail, _ in _read(parser.parse(pattern))}
    if not all(sets):
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)
