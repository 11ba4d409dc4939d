"""Secrets in texts: a trigram index proposes (rule, document) candidates, regular expressions verify them.

Each rule's expression is turned into a Boolean trigram query. The index holds postings of just those trigrams that
some rule's query names; a rule's candidates are the documents whose postings meet all trigrams of one of its sets.
Only candidates are searched with the expression; rules that require no trigram search every text. DataFrame
operations only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, few, fresh, materialise, tasks_for
from .trigram_query import trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression (one dialect for Java and this module), and the least length of its whole match, or of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False


#: The three base kinds, in their order, then well-known credential formats. Expressions of which only long
#: matches count carry their length where that finds the same matches.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: Matches of one text whose lengths are summed one by one.
BLOCK = 64


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(rule: Rule, text: str) -> str:
    """SQL: spans (start, rank, kind, stop, match) of a rule in a text, found leftmost without overlaps.

    Pieces between matches and matches alternate, so running lengths give places, in code points. Lengths are summed in blocks, then
    within each block: arrays that grow one by one would cost the square of the number of matches.
    """
    rank = RULES.index(rule) if rule in RULES else len(RULES)
    java = _sql(("(?i)" if rule.ignore_case else "") + rule.pattern)
    found = f"regexp_extract_all({text}, {java}, 0)"
    pairs = f"zip_with(split({text}, {java}, -1), {found}, (p, m) -> if(m is null, null, struct(length(p) + length(m) as n, m as m)))"
    running = "aggregate({0}, cast(array() as array<int>), (a, x) -> concat(a, array(coalesce(try_element_at(a, -1), 0) + {1})))"
    blocks = f"transform(sequence(0, (size(f) - 1) div {BLOCK}), b -> slice(f, b * {BLOCK} + 1, {BLOCK}))"
    inner = "transform(bs, b -> " + running.format("b", "x.n") + ")"
    upto = "flatten(zip_with(ends, slice(array_insert(" + running.format("ends", "coalesce(try_element_at(x, -1), 0)") + ", 1, 0), 1, size(ends)), (e, base) -> transform(e, x -> x + base)))"
    # each named step is worked out once: a value bound by transform over an array of one
    let = lambda name, value, then: f"element_at(transform(array({value}), {name} -> {then}), 1)"
    spans = "zip_with(f, upto, (x, stop) -> struct(stop - length(x.m) as start, stop as stop, x.m as m))"
    walk = let("f", f"filter({pairs}, x -> x is not null)", let("ends", let("bs", blocks, inner), let("upto", upto, spans)))
    long_enough = f"length(regexp_extract(s.m, {java}, {rule.group})) >= {rule.least}"
    return f"transform(filter({walk}, s -> {long_enough}), s -> struct(s.start as start, {rank} as rank, '{rule.kind}' as kind, s.stop as stop, s.m as match))"


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, rules: the rules (by name) whose trigram queries a document's postings meet. docs: doc_id, text."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    wanted = [(kind, i, g, len(s)) for kind, q in queries.items() for i, s in enumerate(q) for g in sorted(s)]
    if not wanted:
        return docs.select("doc_id", F.lit(None).cast("array<string>").alias("rules")).limit(0)
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.filter(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull())
    postings = low.select("doc_id", F.explode(held).alias("gram"))
    values = ", ".join(f"({_sql(kind)}, {part}, {_sql(gram)}, {need})" for kind, part, gram, need in wanted)
    asked = docs.sparkSession.sql(f"select * from values {values} as t(kind, part, gram, need)")  # as many rows as the rules name trigrams
    met = postings.join(F.broadcast(asked), "gram").groupBy("doc_id", "kind", "part", "need").agg(F.count_distinct("gram").alias("have")).where("have = need")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def _found(df: DataFrame, out: str, id_col: str, text_col: str, rules: tuple[Rule, ...], most: int) -> DataFrame:
    """df with its secrets in a new column `out`. Helpers are named so that they meet none of df's names."""
    of, named, text = fresh([*df.columns, out], "of", "rules", "text")
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    proposed = materialise(candidates(docs, rules), "candidates", tasks_for(df, True))
    small = few(proposed, most)
    proposed = proposed.select(F.col("doc_id").alias(of), F.col("rules").alias(named))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    if small:  # texts stay where they are
        joined = df.join(F.broadcast(proposed), F.col(id_col) == F.col(of), "left")
    else:  # only texts that hold what some query asks for are exchanged
        low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
        asked = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(low, F.lit(g)) for g in sorted(s)]) for q in queries.values() for s in q])
        meets = F.col(id_col).isNotNull() & asked
        rest = df.where(~meets).withColumns({of: F.lit(None).cast(proposed.schema[of].dataType), named: F.lit(None).cast("array<string>")})
        joined = df.where(meets).join(proposed, F.col(id_col) == F.col(of), "left").unionByName(rest)
    joined = joined.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    none = "cast(array() as array<struct<start:int,rank:int,kind:string,stop:int,match:string>>)"
    parts: list[Column] = []
    for r in rules:
        java = _sql(("(?i)" if r.ignore_case else "") + r.pattern)
        tried = f"`{text}` rlike {java}" if r.kind not in queries else f"(`{id_col}` is null or array_contains(`{named}`, '{r.kind}')) and `{text}` rlike {java}"
        parts.append(F.expr(f"if({tried}, {_spans(r, f'`{text}`')}, {none})"))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), F.sort_array(reduce(lambda a, b: F.concat(a, b), parts)).alias(out))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a column secrets: array of (start, rank, kind, stop, match) by start, then rank; places in code points, stop exclusive.

    Candidates are counted: up to `most` of them are sent to every task, and no text is exchanged; beyond that, only texts that hold all
    trigrams of some query are. Null text counts as empty. A row without id is searched by every rule; rows that repeat an id share
    candidates, which verification puts right. An input column named secrets gives way, others may have any names. No rows give no rows.
    """
    return _found(df.drop("secrets"), "secrets", id_col, text_col, rules, most)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, its columns whatever their names, with every secret's span in the text replaced by the mask; overlapping spans are masked as one.
    Null stays null."""
    (spans,) = fresh(df.columns, "spans")
    found = _found(df, spans, id_col, text_col, rules, most)
    # a span that starts within what is masked already only extends it
    merged = f"""aggregate(`{spans}`, cast(array() as array<struct<start:int,stop:int>>), (a, s) -> if(size(a) > 0 and s.start < element_at(a, -1).stop,
        concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).stop, s.stop) as stop))), concat(a, array(struct(s.start as start, s.stop as stop)))))"""
    text = f"`{text_col}`"
    before = f"transform(m, (s, i) -> substring({text}, if(i = 0, 0, m[greatest(i, 1) - 1].stop) + 1, s.start - if(i = 0, 0, m[greatest(i, 1) - 1].stop)))"
    cut = F.expr(f"element_at(transform(array({merged}), m -> concat(array_join(concat({before}, array('')), {_sql(mask)}), substring({text}, element_at(m, -1).stop + 1))), 1)")
    masked = F.when(F.size(spans) > 0, cut).otherwise(F.col(text_col)).alias(text_col)
    return found.select(*(masked if c == text_col else F.col(f"`{c}`") for c in df.columns)).coalesce(tasks_for(df))


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row, from find_secrets()."""
    found = find_secrets(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(write(base).cast("binary"), 256).alias("base_sha256"), write(F.col("secrets")).alias("spans"))
