"""The search rules once more, in plain Python, to hold the engine against. Spelling and folding are the engine's, which test_text.py holds
against written results; reading a query, its rules and its scores are stated here on their own."""

import math

from phrasewright.functions.query_text import fold, norm_dev, to_roman

# Words that go from a query of several words if others are left.
STOP = set(
    "a an the i im me my you your he she it we they is am are was be do does did to of in on at for and or this that have has can will would please some any".split()
)
WHITE = " \t\n\x0b\f\r\u00a0\ufeff"


def read(text):
    """side, phrase, tokens and the length typed."""
    typed = (text or "").strip(WHITE)
    devanagari = any(0x900 <= ord(c) <= 0x97F for c in typed)
    phrase = norm_dev(typed) if devanagari else fold(typed)
    tokens = phrase.split()
    if not devanagari and len(tokens) > 1 and set(tokens) - STOP:
        tokens = [t for t in tokens if t not in STOP]
    return devanagari, phrase, tokens, sum(2 if ord(c) > 0xFFFF else 1 for c in typed)


def pairs(s):
    return {a + b for a, b in zip(s, s[1:])}  # noqa: B905


def likeness(word, token):
    if len(word) < 3 or len(pairs(token)) < 2:
        return 0
    return 2 * len(pairs(word) & pairs(token)) / (len(pairs(word)) + len(pairs(token)))


def same_stem(word, token):
    """Three characters at least, and seven tenths of the token, begin both."""
    need = max(3, math.ceil(len(token) * 7 / 10))
    return len(token) >= need and word[:need] == token[:need]


#: Each rule is a condition and what it scores; the best that holds counts.
FIELD_RULES = [(lambda f, t: f == t, 5), (lambda f, t: f.startswith(t), 4), (lambda f, t: t in f, 3)]
WORD_RULES = [(lambda w, t: w == t, 4.5), (lambda w, t: w.startswith(t), 3.5), (same_stem, 2.5)]


def token_score(token, fields):
    words = [w for f in fields for w in f.split(" ") if w]
    found = [n for f in fields if f for rule, n in FIELD_RULES if rule(f, token)] + [n for w in words for rule, n in WORD_RULES if rule(w, token)]
    return max([0, *found, *(1 + x for w in words if (x := likeness(w, token)) >= 0.55)])


def keys(r):
    dev = [norm_dev(r["hindi"]), norm_dev(r["marathi"])]
    rom = [fold(r["roman"] or to_roman(r["hindi"])), fold(to_roman(r["marathi"])), fold(r["english"].translate(str.maketrans("/()", "   ")))]
    return dev, rom


def search(rows, text, situation=None):
    """(idx, score) in rank order."""
    devanagari, phrase, tokens, typed = read(text)
    rows = [r for r in rows if not situation or r["situation"] == situation]
    if not (text or "").strip(WHITE):
        return [(r["idx"], None) for r in sorted(rows, key=lambda r: r["idx"])]
    out = []
    for r in rows if tokens else []:
        fields = keys(r)[not devanagari]
        scores = [token_score(t, fields) for t in tokens]
        if not all(scores):
            continue
        score = sum(scores) / len(scores) + min(1, typed / max(1, len(fields[0])))
        if " " in phrase:
            score += next((4 if f == phrase else 2 for f in fields if phrase in f), 0)
        score *= {"built": 0.92, "corpus": 0.8}.get(r["tier"], 1)
        score *= 1.08 if r["status"] == "ok" else 1
        out.append((r["idx"], score, len(r["hindi"])))
    return [(i, s) for i, s, _ in sorted(out, key=lambda x: (-x[1], x[2], x[0]))]
