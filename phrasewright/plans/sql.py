"""The engine's rules as DuckDB SQL text, written from the rules and not from the Column code, to hold queries against. Letter tables and the
order of the folds are fixed values of the rules and shared; how a text is read is written down here by hand."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..functions.text import CODES, CONSONANTS, DROPPED_MARKS, DROPPED_POINTS, FOLDS, HALANT, LETTERS, LOWER, SIGNS, SPACE_CLASS, SPACES, UPPER

#: Devanagari stand-ins for a to z, so that Latin names exercise the Devanagari side too.
STAND_INS = "ाबचदेफगहिजकलमनोपखरसतुवभं्झ"
_GAP = chr(0xF000)


class Text(NamedTuple):
    """How a registered text is to be read: its side, phrase and tokens, and its length as typed. Written down by hand from the rules, so
    that a slip in the engine's own reading shows."""

    side: str
    phrase: str
    tokens: tuple[str, ...]
    typed: int

    @property
    def several(self) -> bool:
        return " " in self.phrase


#: The registered texts. w is read as v, z as j, a letter twice as once; English function words go where others are left.
READ = {
    "wiget": Text("rom", "viget", ("viget",), 5),
    "red wiget": Text("rom", "red viget", ("red", "viget"), 9),
    "smal promo gear": Text("rom", "smal promo gear", ("smal", "promo", "gear"), 15),
    "red widget": Text("rom", "red vidget", ("red", "vidget"), 10),
    "bolt": Text("rom", "bolt", ("bolt",), 4),
    "smal blue": Text("rom", "smal blue", ("smal", "blue"), 9),
    "I am the red bolt": Text("rom", "i am the red bolt", ("red", "bolt"), 17),
    "me an": Text("rom", "me an", ("me", "an"), 5),
    "re": Text("rom", "re", ("re",), 2),
    "b widget": Text("rom", "b vidget", ("b", "vidget"), 8),
    "qqq bolt": Text("rom", "q bolt", ("q", "bolt"), 8),
    "kuk bolt": Text("rom", "kuk bolt", ("kuk", "bolt"), 8),
    "vidgett": Text("rom", "vidget", ("vidget",), 7),
    "larg": Text("rom", "larg", ("larg",), 4),
    "blue anvil": Text("rom", "blue anvil", ("blue", "anvil"), 10),
    "small wiget": Text("rom", "smal viget", ("smal", "viget"), 11),
    "smal vidgett": Text("rom", "smal vidget", ("smal", "vidget"), 12),
    "anvilarge": Text("rom", "anvilarge", ("anvilarge",), 9),
    "blue anvilarge": Text("rom", "blue anvilarge", ("blue", "anvilarge"), 14),
    "gizmoo": Text("rom", "gijmu", ("gijmu",), 6),
    "vidget ring": Text("rom", "vidget ring", ("vidget", "ring"), 11),
    "cold rod": Text("rom", "cold rod", ("cold", "rod"), 8),
    "economy": Text("rom", "economy", ("economy",), 7),
    "the big plate": Text("rom", "the big plate", ("big", "plate"), 13),
    "zzz": Text("rom", "j", ("j",), 3),
    "hot gear": Text("rom", "hot gear", ("hot", "gear"), 8),
    "विदगेत": Text("dev", "विदगेत", ("विदगेत",), 6),
    "रेद विदगेत": Text("dev", "रेद विदगेत", ("रेद", "विदगेत"), 10),
}
#: Leading characters that a word must share with a token of so many: seven tenths of them, rounded up, and three at least.
STEMS = {1: 3, 2: 3, 3: 3, 4: 3, 5: 4, 6: 5, 7: 5, 8: 6, 9: 7, 10: 7, 11: 8, 12: 9}


def ngrams(s: str, n: int) -> list[str]:
    """The different stretches of n characters of a literal, first ones first."""
    out = []
    for i in range(len(s) - n + 1):
        if s[i : i + n] not in out:
            out.append(s[i : i + n])
    return out


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '{SPACE_CLASS}+', ' ', 'g'))"


def fold(e: str) -> str:
    e = f"regexp_replace(lower(coalesce({e}, '')), '[^a-z{SPACES}]', '', 'g')"
    for pattern, to in FOLDS:
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    for c in LOWER:
        e = f"regexp_replace({e}, '{c}+', '{c}', 'g')"
    return squeeze(e)


def fold_english(e: str) -> str:
    return fold(f"translate(coalesce({e}, ''), '/()', '   ')")


def to_roman(e: str) -> str:
    e = f"regexp_replace(coalesce({e}, ''), '([{''.join(CONSONANTS)}])', '\\1{_GAP}', 'g')"
    e = f"replace(regexp_replace({e}, '{_GAP}([{''.join(SIGNS)}{HALANT}])', '\\1', 'g'), '{_GAP}', 'a')"
    e = f"regexp_replace(regexp_replace({e}, '{SPACE_CLASS}', ' ', 'g'), '[^a-zA-Z0-9 {''.join(LETTERS)}]', '', 'g')"
    e = f"translate({e}, '{UPPER}{''.join(LETTERS)}', '{LOWER}{''.join(CODES.get(v, v) for v in LETTERS.values())}')"
    for spelled, code in CODES.items():
        e = f"replace({e}, '{code}', '{spelled}')"
    return f"trim(regexp_replace({e}, ' +', ' ', 'g'))"


def norm_dev(e: str) -> str:
    return f"trim(lower(regexp_replace(translate(coalesce({e}, ''), {quoted(DROPPED_MARKS + DROPPED_POINTS)}, ''), '{SPACE_CLASS}+', ' ', 'g')))"


def escape_html(e: str) -> str:
    for x, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        e = f"replace({e}, {quoted(x)}, {quoted(to)})"
    return e


def grams(e: str, n: int) -> str:
    return f"list_distinct(list_transform(generate_series(1, length({e}) - {n - 1}), lambda i: substr({e}, i, {n})))"


def text_list(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def dice(w: str, token: str) -> str:
    own = ngrams(token, 2)
    if len(own) < 2:
        return "0.0::DOUBLE"
    return f"CASE WHEN length({w}) >= 3 THEN 2.0::DOUBLE * len(list_intersect({grams(w, 2)}, {text_list(own)})) / (len({grams(w, 2)}) + {len(own)}) ELSE 0.0::DOUBLE END"


def stem(w: str, token: str) -> str:
    k = STEMS[len(token)]
    return "false" if len(token) < k else f"(length({w}) >= {k} AND left({w}, {k}) = {quoted(token[:k])})"


def word_score(w: str, token: str) -> str:
    t, d = quoted(token), dice(w, token)
    return f"CASE WHEN {w} = {t} THEN 4.5::DOUBLE WHEN starts_with({w}, {t}) THEN 3.5::DOUBLE WHEN {stem(w, token)} THEN 2.5::DOUBLE WHEN {d} >= 0.55::DOUBLE THEN 1.0::DOUBLE + {d} ELSE 0.0::DOUBLE END"


def word_hit(w: str, token: str) -> str:
    t = quoted(token)
    inside = f" OR contains({w}, {t})" if len(token) > 3 else ""
    return f"({w} <> '' AND (starts_with({w}, {t}){inside} OR {stem(w, token)} OR {dice(w, token)} >= 0.55::DOUBLE))"


def token_score(token: str, side: str, n: int) -> str:
    t = quoted(token)
    fields = ", ".join(
        f"CASE WHEN {side}[{i}] = '' THEN 0 WHEN {side}[{i}] = {t} THEN 5 WHEN starts_with({side}[{i}], {t}) THEN 4 WHEN contains({side}[{i}], {t}) THEN 3 ELSE 0 END::DOUBLE" for i in range(1, n + 1)
    )
    return f"greatest({fields}, coalesce(list_max(list_transform({side}_words, lambda w: {word_score('w', token)})), 0.0::DOUBLE))"


#: The phrase corpus that queries run over: part names, with stand-ins for the second language.
PHRASES = f"""
  SELECT p_partkey AS idx, p_name AS hindi, translate(lower(p_name), '{LOWER}', '{STAND_INS}') AS marathi, p_type AS english, '' AS roman, p_brand AS situation, '' AS note,
         CASE WHEN p_size % 5 = 0 THEN 'ok' ELSE '' END AS status, '' AS source, CASE p_size % 3 WHEN 0 THEN 'curated' WHEN 1 THEN 'built' ELSE 'corpus' END AS tier
  FROM part"""
#: A corpus with what the other lacks: spellings given by hand, text that is not composed, characters beyond the first plane, missing texts.
NUKTA_NA, BEYOND = "\u0928\u093c", "\U0001f527"
ODD_PHRASES = f"""
  SELECT p_partkey AS idx, CASE p_partkey % 4 WHEN 0 THEN translate(lower(p_name), '{LOWER}', '{STAND_INS}') WHEN 1 THEN p_name || ' {BEYOND}{BEYOND}' WHEN 2 THEN '{NUKTA_NA}' || translate(lower(p_name), '{LOWER}', '{STAND_INS}') ELSE p_name END AS hindi,
         CASE WHEN p_partkey % 3 = 0 THEN '' ELSE translate(lower(p_name), '{LOWER}', '{STAND_INS}') || ' {NUKTA_NA}' END AS marathi, p_type || ' (' || p_brand || ')/' AS english,
         CASE WHEN p_partkey % 4 = 0 AND p_partkey % 8 = 0 THEN p_name ELSE '' END AS roman, p_brand AS situation, '' AS note, '' AS status, '' AS source, 'curated' AS tier
  FROM part"""
SHOWN = "idx, hindi, marathi, english, roman, situation, note, status, source, tier"
_WORDS = "list_distinct(list_filter(flatten([string_split(f, ' ') FOR f IN {0}]), lambda w: w <> ''))"


def keyed(phrases: str, compose: bool = False) -> str:
    """CTEs phrases, fields and keyed: a corpus with its search keys."""
    hindi, marathi = ("nfc_normalize(hindi)", "nfc_normalize(marathi)") if compose else ("hindi", "marathi")
    return f"""
phrases AS ({phrases}),
fields AS (SELECT *, [{norm_dev(hindi)}, {norm_dev(marathi)}] AS dev,
                  [{fold("CASE WHEN roman <> '' THEN roman ELSE " + to_roman(hindi) + " END")}, {fold(to_roman(marathi))}, {fold_english("english")}] AS rom FROM phrases),
keyed AS (SELECT *, rom[3] AS en, {_WORDS.format("dev")} AS dev_words, {_WORDS.format("rom")} AS rom_words FROM fields)"""


KEYED, ODD_KEYED = keyed(PHRASES), keyed(ODD_PHRASES, True)
#: Length in UTF-16 units.
UNITS = "(length(hindi) + length(regexp_replace(hindi, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"
ORDER = f"score DESC, {UNITS}, idx"


def scored(text: str, pool: str = "keyed") -> str:
    """Rows of the pool that match, with their score."""
    q = READ[text]
    side, n = q.side, 2 if q.side == "dev" else 3
    names = [f"s{i}" for i in range(len(q.tokens))]
    cols = ", ".join(f"{token_score(t, side, n)} AS {c}" for c, t in zip(names, q.tokens, strict=True))
    score = f"({' + '.join(names)}) / {len(names)}::DOUBLE + least(1.0::DOUBLE, {q.typed}::DOUBLE / greatest(1, length({side}[1]) + length(regexp_replace({side}[1], '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))))"
    if q.several:
        p = quoted(q.phrase)
        score += " + CASE " + " ".join(f"WHEN {side}[{i}] = {p} THEN 4.0::DOUBLE WHEN contains({side}[{i}], {p}) THEN 2.0::DOUBLE" for i in range(1, n + 1)) + " ELSE 0.0::DOUBLE END"
    weights = "* CASE WHEN tier = 'built' THEN 0.92::DOUBLE ELSE 1.0 END * CASE WHEN tier = 'corpus' THEN 0.8::DOUBLE ELSE 1.0 END * CASE WHEN status = 'ok' THEN 1.08::DOUBLE ELSE 1.0 END"
    return f"SELECT {SHOWN}, ({score}) {weights} AS score FROM (SELECT *, {cols} FROM {pool}) WHERE {' AND '.join(f'{c} > 0' for c in names)}"


def search(text: str, situation: str | None = None, limit: int | None = None, corpus: str = KEYED) -> str:
    inner = scored(text)
    where = f" WHERE situation = {quoted(situation)}" if situation else ""
    return f"WITH {corpus} SELECT {SHOWN}, round(score, 9) AS score FROM (SELECT * FROM ({inner}){where} ORDER BY {ORDER}" + (f" LIMIT {limit}" if limit else "") + ")"


POSTINGS = f"""
postings AS (SELECT DISTINCT side, idx, unnest(g) AS gram FROM (
  SELECT 'dev' AS side, idx, flatten([{grams("f", 3)} FOR f IN dev]) AS g FROM keyed UNION ALL SELECT 'rom', idx, flatten([{grams("f", 3)} FOR f IN rom]) FROM keyed)),
counts AS (SELECT side, gram, count(*) AS df FROM postings GROUP BY ALL)"""


def candidates(text: str) -> str:
    """CTEs: own (token, gram, place), probes and pool (idx) of a query, over postings and counts."""
    q = READ[text]
    side, use = q.side, [t for t in q.tokens if len(t) >= 3]
    own = ", ".join(f"({i}, {quoted(g)}, {p})" for i, t in enumerate(use) for p, g in enumerate(ngrams(t, 3)))
    return f"""
own AS (SELECT t.*, df FROM (VALUES {own}) t(token, gram, place) JOIN counts USING (gram) WHERE side = '{side}'),
firsts AS (SELECT token, min(place) AS place FROM own GROUP BY token),
probes AS (
  SELECT token, gram FROM own JOIN firsts USING (token, place)
  UNION ALL SELECT token, gram FROM (SELECT o.token, o.gram, row_number() OVER (PARTITION BY o.token ORDER BY o.df, o.place) AS r FROM own o JOIN firsts f ON o.token = f.token AND o.place > f.place) WHERE r <= 2),
pool AS (SELECT idx FROM postings JOIN probes USING (gram) WHERE side = '{side}' GROUP BY idx HAVING count(DISTINCT token) = {len(use)})"""


def candidates_of(text: str, i: int) -> str:
    """candidates(), its tables numbered."""
    own = candidates(text)
    for name in ("own", "firsts", "probes", "pool"):
        own = re.sub(rf"\b{name}\b", f"{name}{i}", own)
    return own
