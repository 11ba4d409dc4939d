"""Queries over the driver's tables, one per operator, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.score import dice, stem, token_score, word_hit
from ..operators.highlight import highlight
from ..functions.query_text import parse_query
from ..operators.parity import except_keys, head_agrees, parity
from ..operators.rows import complete, count_label, index_rows, situations, spread, strip, tier_counts, union_tiers
from ..operators.search import PhraseIndex, batch_search, gram_counts, postings, ranked, search, total_postings, word_postings
from ..operators.templates import expand
from ..sources.csv import read_sheet, read_sheet_strict
from ..sources.synthetic import Draws, categories, corpus_of, noun_table
from ..sources.tiers import load_tiers
from ..streaming.requests import answer, latest_requests, search_stream
from . import sql
from .scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase corpus: part names as the first language, stand-ins as the second, types as English, brands as situations."""
    size = F.col("p_size")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        F.col("p_partkey").alias("idx"), F.col("p_name").alias("hindi"), F.translate(F.lower("p_name"), T.LOWER, sql.STAND_INS).alias("marathi"), F.col("p_type").alias("english"),
        F.lit("").alias("roman"), F.col("p_brand").alias("situation"), F.lit("").alias("note"), F.when(size % 5 == 0, "ok").otherwise("").alias("status"), F.lit("").alias("source"),
        F.when(size % 3 == 0, "curated").when(size % 3 == 1, "built").otherwise("corpus").alias("tier"),
    )


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_rows(phrases(spark, sf_dir), compose=False)  # this text is composed already


def odd_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus with spellings given by hand, text that is not composed, characters beyond the first plane and missing texts."""
    key, dev = F.col("p_partkey"), F.translate(F.lower("p_name"), T.LOWER, sql.STAND_INS)
    hindi = F.when(key % 4 == 0, dev).when(key % 4 == 1, F.concat("p_name", F.lit(f" {sql.BEYOND * 2}"))).when(key % 4 == 2, F.concat(F.lit(sql.NUKTA_NA), dev)).otherwise(F.col("p_name"))
    return index_rows(spread(table(spark, sf_dir, "part"), "p_partkey").select(
        key.alias("idx"), hindi.alias("hindi"), F.when(key % 3 != 0, F.concat(dev, F.lit(f" {sql.NUKTA_NA}"))).alias("marathi"), F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")/")).alias("english"),
        F.when(key % 8 == 0, F.col("p_name")).alias("roman"), F.col("p_brand").alias("situation"), F.lit("curated").alias("tier"),
    ))


#: Indexes that are written already, by application and data.
_SAVED: dict[tuple[str, str], str] = {}


def saved(spark: SparkSession, sf_dir: str) -> PhraseIndex:
    """The corpus's index, written once for each application and opened from there."""
    own = spark.sparkContext.applicationId, sf_dir
    if own not in _SAVED:
        path = scratch(spark)
        PhraseIndex.build(keyed(spark, sf_dir)).save(path)
        _SAVED[own] = path
    return PhraseIndex.load(spark, _SAVED[own])


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(keyed(spark, sf_dir), "wiget", limit=200)


# --- ranked search: name -> (query, situation, limit) ---
SEARCHES = {
    "search_exhaustive": ("red wiget", None, None),
    "search_one_token": ("wiget", None, None),
    "search_multi": ("smal promo gear", None, None),
    "search_phrase_bonus": ("red widget", None, None),
    "search_situation": ("bolt", "Brand#11", None),
    "search_limit": ("smal blue", None, 25),
    "search_stopwords": ("I am the red bolt", None, None),
    "search_all_stop": ("me an", None, None),
    "search_short_token": ("re", None, None),
    "search_mixed_length": ("b widget", None, None),
    "search_devanagari": ("विदगेत", None, None),
    "search_devanagari_phrase": ("रेद विदगेत", None, None),
    "search_fuzzy": ("vidgett", None, None),
    "topk_order": ("larg", None, 200),
}


def _register_searches() -> None:
    for name, (text, situation, limit) in SEARCHES.items():
        def run(spark: SparkSession, sf_dir: str, text=text, situation=situation, limit=limit) -> DataFrame:
            return rounded(search(keyed(spark, sf_dir), text, situation, limit))

        QUERIES[name], ORACLE_SQL[name] = run, sql.search(text, situation, limit)


_register_searches()

#: The same over the corpus of odd rows.
ODD_SEARCHES = {"search_roman_given": ("red widget", None), "search_composed": ("विदगेत", None), "search_astral_order": ("blue anvil", 60)}


def _register_odd_searches() -> None:
    for name, (text, limit) in ODD_SEARCHES.items():
        def run(spark: SparkSession, sf_dir: str, text=text, limit=limit) -> DataFrame:
            return rounded(search(odd_keyed(spark, sf_dir), text, limit=limit))

        QUERIES[name], ORACLE_SQL[name] = run, sql.search(text, None, limit, sql.ODD_KEYED)


_register_odd_searches()


@query(f"WITH phrases AS ({sql.PHRASES}) SELECT {sql.SHOWN}, NULL::DOUBLE AS score FROM phrases ORDER BY idx LIMIT 50")
def search_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(keyed(spark, sf_dir), "  ", limit=50)


@query(f"WITH phrases AS ({sql.PHRASES}) SELECT {sql.SHOWN}, NULL::DOUBLE AS score FROM phrases WHERE false")
def search_norm_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(keyed(spark, sf_dir), "123 ???")


@query(f"WITH {sql.KEYED} SELECT idx, row_number() OVER (ORDER BY {sql.ORDER}) AS rank FROM ({sql.scored('blue anvil')}) ORDER BY rank LIMIT 100")
def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(search(keyed(spark, sf_dir), "blue anvil", limit=100)).select("idx", F.col("rank").cast("long").alias("rank"))


# --- normalisers ---
@query(f"SELECT doc_id, {sql.fold('text')} AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(f"SELECT conv_id, turn, {sql.fold_english('text')} AS folded FROM conversations")
def fold_english_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.fold_english(F.col("text")).alias("folded"))


@query(f"WITH phrases AS ({sql.PHRASES}) SELECT idx, {sql.to_roman('nfc_normalize(marathi)')} AS roman, {sql.fold(sql.to_roman('nfc_normalize(marathi)'))} AS folded FROM phrases")
def to_roman_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = phrases(spark, sf_dir).select("idx", T.nfc("marathi").alias("m"))
    return composed.select("idx", T.to_roman(F.col("m")).alias("roman"), T.fold(T.to_roman(F.col("m"))).alias("folded"))


@query(f"WITH phrases AS ({sql.PHRASES}) SELECT idx, {sql.norm_dev("marathi || ' (' || english || ')।'")} AS cleaned, regexp_matches(marathi, '[ऀ-ॿ]') AS devanagari FROM phrases")
def norm_dev_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phrases(spark, sf_dir)
    return p.select("idx", T.norm_dev(F.concat("marathi", F.lit(" ("), "english", F.lit(")।"))).alias("cleaned"), T.is_devanagari(F.col("marathi")).alias("devanagari"))


@query(f"SELECT page_id, {sql.escape_html('html')} AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


# --- search keys and the trigram index ---
@query(f"WITH {sql.KEYED} SELECT idx, array_to_string(dev, '/') AS dev, array_to_string(rom, '/') AS rom, array_to_string(list_sort(dev_words), ' ') AS dev_words, array_to_string(list_sort(rom_words), ' ') AS rom_words FROM keyed")
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c, s, how=lambda x: x: F.array_join(how(F.col(c)), s).alias(c)
    return keyed(spark, sf_dir).select("idx", join("dev", "/"), join("rom", "/"), join("dev_words", " ", F.sort_array), join("rom_words", " ", F.sort_array))


@query(f"WITH {sql.KEYED}, {sql.POSTINGS} SELECT side, gram, idx FROM postings")
def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(keyed(spark, sf_dir))


@query(f"WITH {sql.KEYED}, {sql.POSTINGS} SELECT side, gram, df FROM counts")
def gram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_counts(postings(keyed(spark, sf_dir)))


@query(f"SELECT item_id, array_to_string(list_sort({sql.grams('text', 2)}), '/') AS bigrams FROM benchmark")
def bigram_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.sort_array(T.ngrams(F.col("text"), 2)), "/").alias("bigrams"))


@query(f"WITH {sql.KEYED}, {sql.POSTINGS} SELECT side, count(*) AS grams, sum(df)::BIGINT AS postings FROM counts GROUP BY side")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_postings(saved(spark, sf_dir).counts)


@query(f"WITH {sql.KEYED}, {sql.POSTINGS}, {sql.candidates('small wiget')} SELECT token, gram FROM probes")
def probe_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = saved(spark, sf_dir).probes(parse_query("small wiget"))
    rows = ", ".join(f"({i}, '{g}')" for i, p in enumerate(probes) for g in p)
    return spark.sql(f"select * from values {rows} as t(token, gram)")


@query(f"WITH {sql.KEYED}, {sql.POSTINGS}, {sql.candidates('small wiget')} SELECT idx FROM pool")
def index_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir).candidates(parse_query("small wiget"))


def _indexed_sql(text: str, where: str = "") -> str:
    return f"WITH {sql.KEYED}, {sql.POSTINGS}, {sql.candidates(text)} SELECT {sql.SHOWN}, round(score, 9) AS score FROM ({sql.scored(text, '(SELECT * FROM keyed SEMI JOIN pool USING (idx))')}){where}"


@query(_indexed_sql("small wiget"))
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved(spark, sf_dir).search("small wiget"))


@query(_indexed_sql("blue anvilarge", " WHERE situation = 'Brand#11'"))
def search_indexed_situation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved(spark, sf_dir).search("blue anvilarge", "Brand#11"))


@query(_indexed_sql("b widget"))
def search_indexed_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved(spark, sf_dir).search("b widget"))


@query(_indexed_sql("रेद विदगेत"))
def search_indexed_devanagari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved(spark, sf_dir).search("रेद विदगेत"))


@query(
    f"WITH {sql.KEYED}, {sql.POSTINGS}, {sql.candidates('b widget')}, {sql.candidates_of('kuk bolt', 1)} SELECT 're' AS text, count(*) AS n FROM ({sql.scored('re')}) UNION ALL "
    f"SELECT 'b widget', count(*) FROM ({sql.scored('b widget', '(SELECT * FROM keyed SEMI JOIN pool USING (idx))')}) UNION ALL "
    f"SELECT 'kuk bolt', count(*) FROM ({sql.scored('kuk bolt', '(SELECT * FROM keyed SEMI JOIN pool1 USING (idx))')})"
)
def index_odd_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the index finds for a text of short tokens only, for one that holds a short token, for one with grams no row holds."""
    index = saved(spark, sf_dir)
    return reduce(DataFrame.unionByName, [index.search(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("text"), "n") for t in ("re", "b widget", "kuk bolt")])


@query(sql.search("smal vidgett"))
def search_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved(spark, sf_dir).search("smal vidgett", complete=True))


@query(f"WITH {sql.KEYED} SELECT 'rom' AS side, unnest(rom_words) AS word, idx FROM keyed UNION ALL SELECT 'dev', unnest(dev_words), idx FROM keyed")
def word_postings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_postings(keyed(spark, sf_dir))


# --- what the index leaves out: fuzzy matches through grams that are not probed ---
LOSSY = "anvilarge"
_PARITY = f"WITH {sql.KEYED}, {sql.POSTINGS}, {sql.candidates(LOSSY)}, one AS ({sql.scored(LOSSY)}), two AS ({sql.scored(LOSSY, '(SELECT * FROM keyed SEMI JOIN pool USING (idx))')}), other AS ({sql.scored('hot gear')})"


@query(f"{_PARITY} SELECT hindi || '|' || marathi AS key, idx FROM one ANTI JOIN two USING (hindi, marathi)")
def parity_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = saved(spark, sf_dir)
    return except_keys(index.search(LOSSY, exhaustive=True), index.search(LOSSY)).select("key", "idx")


@query(f"{_PARITY} SELECT 'indexed, not exhaustive' AS of, count(*) AS n FROM (SELECT * FROM two ANTI JOIN one USING (hindi, marathi)) UNION ALL SELECT 'another text', count(*) FROM (SELECT * FROM two ANTI JOIN other USING (hindi, marathi))")
def parity_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one list that another has not, counted: none that the index finds and the scan does not; many against another text's."""
    index = saved(spark, sf_dir)
    pairs = {"indexed, not exhaustive": index.search(LOSSY, exhaustive=True), "another text": index.search("hot gear", exhaustive=True)}
    return reduce(DataFrame.unionByName, [except_keys(index.search(LOSSY), other).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("of"), "n") for name, other in pairs.items()])


PARITY_TEXTS = ["anvilarge", "blue anvilarge", "gizmoo", "smal promo gear", "vidget ring"]


def _parity_sql(i: int, text: str, where: str) -> str:
    ranked = lambda name, pool: f"{name}{i} AS (SELECT idx, row_number() OVER (ORDER BY {sql.ORDER}) AS r FROM ({sql.scored(text, pool)}){where})"
    return f"{sql.candidates_of(text, i)}, {ranked('full_', 'keyed')}, {ranked('part_', f'(SELECT * FROM keyed SEMI JOIN pool{i} USING (idx))')}"


def _report_sql(texts: list[str], where: str = "") -> str:
    report = " UNION ALL ".join(
        f"SELECT {sql.quoted(t)} AS query, count(f.r) AS found, count(*) FILTER (p.r IS NULL) AS missed, count(*) FILTER (f.r IS NULL) AS extra, coalesce(max(f.r) FILTER (p.r IS NULL), 0) AS deepest, "
        f"count(*) FILTER ((f.r <= 20 OR p.r <= 20) AND f.r IS DISTINCT FROM p.r) = 0 AS page_same FROM full_{i} f FULL JOIN part_{i} p ON f.idx = p.idx"
        for i, t in enumerate(texts)
    )
    return f"WITH {sql.KEYED}, {sql.POSTINGS}, {', '.join(_parity_sql(i, t, where) for i, t in enumerate(texts))} {report}"


@query(_report_sql(PARITY_TEXTS))
def parity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity(saved(spark, sf_dir), PARITY_TEXTS, 20)


@query(_report_sql(["anvilarge", "red wiget"], " WHERE situation = 'Brand#11'"))
def parity_situation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity(saved(spark, sf_dir), ["anvilarge", "red wiget"], 20, "Brand#11")


@query(f"WITH {sql.KEYED} " + " UNION ALL ".join(f"SELECT {sql.quoted(t)} AS query, r AS rank, idx, r AS whole FROM (SELECT idx, row_number() OVER (ORDER BY {sql.ORDER}) AS r FROM ({sql.scored(t)})) WHERE r <= 25" for t in ("smal blue", "red wiget", "रेद विदगेत")))
def head_of_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_agrees(saved(spark, sf_dir), ["smal blue", "red wiget", "रेद विदगेत"], 25, exhaustive=True)


# --- scoring ---
@query(f"SELECT p_partkey AS idx, {sql.stem('lower(p_name)', 'widgets')} OR {sql.stem('lower(p_name)', 'rings')} AS same_stem FROM part")
def stem_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.lower("p_name").alias("w"))
    return names.select("idx", F.expr(f"{stem('w', 'widgets')} OR {stem('w', 'rings')}").alias("same_stem"))


@query(f"SELECT DISTINCT n_name AS name, {sql.dice('lower(n_name)', 'united')} AS score FROM nation")
def dice_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.expr(dice("lower(n_name)", "united")).alias("score")).distinct()


@query(f"WITH {sql.KEYED} SELECT idx, {sql.token_score('vigets', 'rom', 3)} AS roman, {sql.token_score('विदग', 'dev', 2)} AS devanagari FROM keyed")
def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keyed(spark, sf_dir)
    return k.select("idx", token_score("vigets", "rom").alias("roman"), token_score("विदग", "dev").alias("devanagari"))


@query(f"SELECT p_partkey AS idx, {' OR '.join(sql.word_hit(f"string_split(lower(p_name), ' ')[{i}]", 'widgets') for i in (1, 2))} AS hit FROM part")
def word_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.split(F.lower("p_name"), " ").alias("w"))
    return parts.select("idx", F.expr(f"{word_hit('w[0]', 'widgets')} OR {word_hit('w[1]', 'widgets')}").alias("hit"))


_MARK = f"CASE WHEN {sql.word_hit(sql.fold(sql.to_roman('w')), 'red')} OR {sql.word_hit(sql.fold(sql.to_roman('w')), 'viget')} THEN '<mark>' || {sql.escape_html('w')} || '</mark>' ELSE {sql.escape_html('w')} END"


@query(f"SELECT p_partkey AS idx, array_to_string(list_transform(string_split(p_name || ' & ' || p_type, ' '), lambda w: {_MARK}), ' ') AS html FROM part")
def highlight_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.concat_ws(" & ", "p_name", "p_type").alias("t"))
    return highlight(texts, "t", "red wiget", "html").select("idx", "html")


_DEV = f"translate(lower(p_name), '{T.LOWER}', '{sql.STAND_INS}')"
_DEV_MARK = f"CASE WHEN {sql.word_hit(sql.norm_dev('w'), 'विदगेत')} THEN '<mark>' || {sql.escape_html('w')} || '</mark>' ELSE {sql.escape_html('w')} END"


@query(f"SELECT p_partkey AS idx, array_to_string(list_transform(string_split({_DEV} || ' & ' || p_type, ' '), lambda w: {_DEV_MARK}), ' ') AS html FROM part")
def highlight_devanagari(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = phrases(spark, sf_dir).select("idx", F.concat_ws(" & ", "marathi", "english").alias("t"))
    return highlight(texts, "t", "विदगेत", "html").select("idx", "html")


# --- templates and tiers ---
PATTERN_ROWS = [
    (0, "a1", "{X} bada", "{X} badi", "", "{X} motha", "{X} mothi", "{X} mothe", "the {X} is big, {X}", "direct", "MACHINERY|BUILDING|MACHINERY", ""),
    (1, "a2", "{X} ko", "", "", "{X}ला", "", "", "to {X}", "dative", "", "n"),
    (2, "a3", "{X} se", "{X} se", "{X} se", "", "", "", "from {X}", "oblique", "AUTOMOBILE", ""),
    (3, "a4", "{X} me", "{X} me", "{X} me", "{X} madhe", "", "{X} madhye", "in {X}", "oblique", " AUTOMOBILE |FURNITURE", ""),
]
_PATTERN_COLUMNS = "ord, id, hi_m, hi_f, hi_n, mr_m, mr_f, mr_n, en, form, takes, note"
_PATTERN_VALUES = ", ".join("(" + ", ".join(sql.quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in PATTERN_ROWS)


def _nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("ord"), F.lower("c_name").alias("hi"), F.upper("c_name").alias("mr"), F.col("c_name").alias("en"), F.when(key % 3 == 0, "M").when(key % 3 == 1, "f").otherwise("?").alias("hi_gender"),
        F.when(key % 2 == 0, "m").otherwise("f").alias("mr_gender"), F.when(key % 4 == 0, F.concat(F.upper("c_name"), F.lit("-O"))).otherwise("").alias("mr_oblique"),
        F.when(key % 5 == 0, "1").otherwise("").alias("honorific"), F.col("c_mktsegment").alias("category"),
    )


def _first(e: str, what: str, to: str) -> str:
    return f"CASE WHEN instr({e}, {what}) > 0 THEN substr({e}, 1, instr({e}, {what}) - 1) || {to} || substr({e}, instr({e}, {what}) + length({what})) ELSE {e} END"


_EXPANDED = f"""
patterns AS (SELECT *, list_distinct(list_filter([trim(t) FOR t IN string_split(takes, '|')], lambda t: t <> '')) AS kinds FROM (VALUES {_PATTERN_VALUES}) t({_PATTERN_COLUMNS})),
nouns AS (SELECT c_custkey AS ord, lower(c_name) AS hi, upper(c_name) AS mr, c_name AS en, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'f' ELSE '?' END AS hi_gender, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'f' END AS mr_gender,
          CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) || '-O' ELSE '' END AS mr_oblique, CASE WHEN c_custkey % 5 = 0 THEN '1' ELSE '' END AS honorific, c_mktsegment AS category FROM customer),
pairs AS (
  SELECT p.ord * 4294967296 + n.ord AS idx, p.id, p.form, p.note, n.hi, n.mr, n.en AS noun_en, p.en, n.mr_oblique, n.honorific, n.category,
         coalesce(nullif(CASE lower(hi_gender) WHEN 'm' THEN hi_m WHEN 'f' THEN hi_f ELSE hi_n END, ''), nullif(hi_n, ''), hi_m) AS h,
         coalesce(nullif(CASE lower(mr_gender) WHEN 'm' THEN mr_m WHEN 'f' THEN mr_f ELSE mr_n END, ''), nullif(mr_n, ''), mr_m) AS m
  FROM patterns p JOIN nouns n ON len(p.kinds) = 0 OR list_contains(p.kinds, n.category)),
polite AS (SELECT *, CASE WHEN form = 'dative' AND honorific <> '' THEN {_first("m", "'{X}ला'", "'{X}ना'")} ELSE m END AS m2, CASE WHEN form <> 'direct' AND mr_oblique <> '' THEN mr_oblique ELSE mr END AS stem FROM pairs WHERE h <> '' AND m <> ''),
built AS (SELECT idx, {_first("h", "'{X}'", "hi")} AS hindi, {_first("m2", "'{X}'", "stem")} AS marathi, replace(en, '{{X}}', noun_en) AS english, '' AS roman, category AS situation, note, 'built' AS status, id AS source, 'built' AS tier FROM polite)"""


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.sql(f"select * from values {_PATTERN_VALUES} as t({_PATTERN_COLUMNS})")
    return expand(patterns, _nouns(spark, sf_dir))


@query(f"WITH {_EXPANDED} SELECT {sql.SHOWN} FROM built")
def expand_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)


_TIERS = f"""{_EXPANDED},
curated AS (SELECT p_partkey AS idx, p_name AS hindi, p_type AS english, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS situation FROM part),
tiers AS (
  SELECT idx, hindi, '' AS marathi, english, '' AS roman, situation, '' AS note, '' AS status, '' AS source, 'curated' AS tier FROM curated
  UNION ALL SELECT idx + 281474976710656, * EXCLUDE (idx) FROM built
  UNION ALL SELECT s_suppkey + 562949953421312, s_name, upper(s_name), '', '', '', '', 'corpus', 'suppliers', 'corpus' FROM supplier)"""


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    curated = part.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("hindi"), F.col("p_type").alias("english"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("situation"))
    corpus = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("hindi"), F.upper("s_name").alias("marathi"), F.lit("suppliers").alias("source"), F.lit("ok").alias("status"))
    return union_tiers(curated, _built(spark, sf_dir), corpus)


@query(f"WITH {_TIERS} SELECT {sql.SHOWN} FROM tiers")
def tier_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir)


@query(f"WITH {_TIERS} SELECT count(*) FILTER (tier = 'curated') AS curated, count(*) FILTER (tier = 'built') AS built, count(*) FILTER (tier = 'corpus') AS corpus FROM tiers")
def tier_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_counts(_tiers(spark, sf_dir))


@query(f"WITH {_TIERS} SELECT count(*) FILTER (tier = 'curated') || ' phrases + ' || count(*) FILTER (tier = 'built') || ' built + ' || count(*) FILTER (tier = 'corpus') || ' from corpora' AS label FROM tiers")
def tier_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_label(tier_counts(_tiers(spark, sf_dir)))


@query(f"WITH {_TIERS} SELECT count(*) FILTER (tier = 'curated') || ' phrases + ' || count(*) FILTER (tier = 'corpus') || ' from corpora' AS label FROM tiers")
def tier_label_without_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_label(tier_counts(_tiers(spark, sf_dir).where("tier <> 'built'")))


@query("SELECT c_mktsegment AS category, min(c_custkey) AS first FROM customer GROUP BY 1")
def noun_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories(_nouns(spark, sf_dir))


@query(f"WITH {_TIERS} SELECT situation, min(idx) AS first_idx FROM tiers WHERE tier = 'curated' AND situation <> '' GROUP BY situation")
def situations_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return situations(_tiers(spark, sf_dir))


@query(f"WITH phrases AS ({sql.PHRASES}) SELECT {sql.SHOWN} FROM phrases")
def strip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(keyed(spark, sf_dir))


@query("SELECT r_regionkey::BIGINT AS idx, r_name AS hindi, '' AS marathi, '' AS english, '' AS roman, '' AS situation, '' AS note, '' AS status, '' AS source, '' AS tier FROM region")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("idx"), F.col("r_name").alias("hindi")))


# --- sheets ---
def _write_sheet(lines: DataFrame, path: str) -> str:
    """One file of text lines, in their order; `ord` and `line`."""
    lines.repartition(1).sortWithinPartitions("ord").select("line").write.text(path)
    return path


def _q() -> Column:
    return F.lit('"')


@query(
    "SELECT p_partkey + 1 AS ord, CASE p_partkey % 5 WHEN 0 THEN p_name || ', ' || p_type WHEN 1 THEN 'x1,2y' || p_name WHEN 2 THEN 'say \"' || p_name || '\"' WHEN 3 THEN p_name || chr(10) || p_type ELSE p_name END AS name, "
    "CASE WHEN p_partkey % 5 = 4 THEN '' ELSE p_brand END AS brand, '' AS missing FROM part"
)
def csv_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted cells, quotes in the middle of a cell, doubled quotes, line ends in quotes, short rows, long rows, blank rows, three kinds of line ends, a byte order mark."""
    key, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    cell = F.when(key % 5 == 0, F.concat(_q(), name, F.lit(", "), kind, _q())).when(key % 5 == 1, F.concat(F.lit('x"1,2"y'), name)).when(key % 5 == 2, F.concat(F.lit('"say ""'), name, F.lit('"""')))
    cell = cell.when(key % 5 == 3, F.concat(_q(), name, F.lit("\n"), kind, _q())).otherwise(F.concat(F.lit(" \u00a0"), name, F.lit("\t")))
    rest = F.when(key % 5 == 4, F.lit("")).when(key % 5 == 0, F.concat(F.lit(","), "p_brand", F.lit(",extra,cells"))).otherwise(F.concat(F.lit(", "), "p_brand", F.lit(" ")))
    end = F.when(key % 3 == 0, F.lit("\r")).when(key % 3 == 1, F.lit("\r\n , \r")).otherwise(F.lit(""))
    lines = table(spark, sf_dir, "part").select((key + 1).alias("ord"), F.concat(cell, rest, end).alias("line"))
    head = spark.sql("select cast(0 as bigint) as ord, '\\ufeffname , brand' as line")
    return read_sheet_strict(spark, _write_sheet(head.union(lines), scratch(spark)), ("name", "brand", "missing"))


@query("SELECT p_name || ', ' || chr(10) || '\"' || p_type || '\"' AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS brand FROM part")
def csv_well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    cell = F.concat(_q(), F.col("p_name"), F.lit(', \n""'), F.col("p_type"), F.lit('"""'))
    lines = table(spark, sf_dir, "part").select((key + 1).alias("ord"), F.concat(cell, F.lit(","), F.when(key % 2 == 0, F.col("p_brand")).otherwise("  ")).alias("line"))
    return read_sheet(spark, _write_sheet(spark.sql("select cast(0 as bigint) as ord, ' name ,brand' as line").union(lines), scratch(spark)))


def _quoted_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *(F.concat(_q(), F.replace(F.coalesce(c.cast("string"), F.lit("")), _q(), F.lit('""')), _q()) for c in columns))


def _sheets(spark: SparkSession, sf_dir: str) -> str:
    """A folder of three sheets made of the driver's tables; the fourth is missing."""
    base = scratch(spark)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("hindi"), F.col("p_type").alias("english"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("situation"), F.lit("ok").alias("status"))
    patterns = spark.sql(f"select * from values {_PATTERN_VALUES} as t({_PATTERN_COLUMNS})").withColumn("ord", F.col("ord").cast("long"))
    for name, sheet in (("phrases", part), ("patterns", patterns), ("nouns", _nouns(spark, sf_dir))):
        columns = [c for c in sheet.columns if c != "ord"]
        head = spark.createDataFrame([(-1, ",".join(columns))], "ord long, line string")
        _write_sheet(head.unionByName(sheet.select(F.col("ord").cast("long").alias("ord"), _quoted_line([F.col(c) for c in columns]).alias("line"))), f"{base}/{name}.csv")
    return base


#: Positions in a sheet count from 1, the keys of the tables from 0.
_LOADED = f"""{_EXPANDED},
loaded AS (
  SELECT p_partkey + 1 AS idx, p_name AS hindi, '' AS marathi, p_type AS english, '' AS roman, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS situation, '' AS note, 'ok' AS status, '' AS source, 'curated' AS tier FROM part
  UNION ALL SELECT idx + 4294967297 + 281474976710656, * EXCLUDE (idx) FROM built)"""


@query(f"WITH {_LOADED} SELECT {sql.SHOWN} FROM loaded")
def tiers_from_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_tiers(spark, _sheets(spark, sf_dir)).rows


@query(f"WITH {_LOADED} SELECT count(*) FILTER (tier = 'curated') AS curated, count(*) FILTER (tier = 'built') AS built, 0::BIGINT AS corpus FROM loaded")
def tiers_from_sheets_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_tiers(spark, _sheets(spark, sf_dir)).counts


# --- the growing corpus ---
#: The generator as a table: one row for each draw, with what has been made of the noun at hand.
_NOUNS_SQL = """
RECURSIVE parts AS (SELECT string_split('क ख ग घ च छ ज झ ट ठ ड ढ त थ द ध न प फ ब भ म य र ल व श स ह', ' ') AS letters, ['', 'ा', 'ि', 'ी', 'ु', 'ू', 'े', 'ै', 'ो', 'ौ'] AS signs, ['m', 'f', 'n'] AS genders, ['FOOD', 'PLACE', 'THING'] AS kinds),
draws AS (
  SELECT 7::BIGINT AS seed, 0 AS n, 'more' AS next, 0 AS i, '' AS w, '' AS g1, '' AS g2, '' AS kind
  UNION ALL
  SELECT s, CASE WHEN next = 'kind' THEN n + 1 ELSE n END,
         CASE next WHEN 'more' THEN CASE WHEN i < 2 + s % 2 THEN 'letter' ELSE 'g1' END WHEN 'letter' THEN 'sign' WHEN 'sign' THEN 'more' WHEN 'g1' THEN 'g2' WHEN 'g2' THEN 'kind' ELSE 'more' END,
         CASE WHEN next = 'sign' THEN i + 1 WHEN next = 'kind' THEN 0 ELSE i END,
         CASE WHEN next = 'letter' THEN w || letters[1 + s % 29] WHEN next = 'sign' THEN w || signs[1 + s % 10] WHEN next = 'kind' THEN '' ELSE w END,
         CASE WHEN next = 'g1' THEN genders[1 + s % 3] ELSE g1 END, CASE WHEN next = 'g2' THEN genders[1 + s % 3] ELSE g2 END, CASE WHEN next = 'kind' THEN kinds[1 + s % 3] || ':' || w ELSE '' END
  FROM (SELECT *, (seed::DOUBLE * 1103515245::DOUBLE + 12345::DOUBLE)::BIGINT & 2147483647 AS s FROM draws) d, parts WHERE n < 60)"""


@query(f"WITH {_NOUNS_SQL} SELECT (n - 1)::INTEGER AS ord, string_split(kind, ':')[2] AS hi, 'thing' || (n - 1) AS en, g1 AS hi_gender, g2 AS mr_gender, string_split(kind, ':')[1] AS category FROM draws WHERE kind <> ''")
def made_up_noun_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noun_table(spark, 0, 60, ["FOOD", "PLACE", "THING"], Draws()).select("ord", "hi", "en", "hi_gender", "mr_gender", "category")


@query(
    f"WITH {_EXPANDED} "
    "SELECT 'given' AS of, (SELECT count(*) FROM part) + (SELECT count(*) FROM built) AS n UNION ALL SELECT 'grown', (SELECT count(*) FROM part) + (SELECT count(*) FROM built)"
)
def corpus_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growing corpus at its own size, twice: with no noun to add it is the base and its built sentences, for fewer nouns as well."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("hindi"))
    patterns, nouns = spark.sql(f"select * from values {_PATTERN_VALUES} as t({_PATTERN_COLUMNS})"), _nouns(spark, sf_dir)
    grown = {"given": nouns.count(), "grown": 0}
    return reduce(DataFrame.unionByName, [corpus_of(base, patterns, nouns, n, Draws()).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("of"), "n") for name, n in grown.items()])


# --- many queries at once, requests ---
BATCH = ["red wiget", "bolt", "smal promo gear", "विदगेत", "cold rod", "economy", "gizmoo", "the big plate", "zzz"]
_BATCH_SQL = " UNION ALL ".join(f"SELECT {sql.quoted(q)} AS query, idx, score, hindi FROM ({sql.scored(q)})" for q in BATCH)


@query(f"WITH {sql.KEYED} SELECT query, idx, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {sql.ORDER}) AS rank FROM ({_BATCH_SQL})) WHERE rank <= 20")
def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batch_search(keyed(spark, sf_dir), BATCH, 20)
    return rounded(found).select("query", "idx", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id AS session, max(event_id) AS seq, max_by(event_type, event_id) AS q, '' AS situation FROM events GROUP BY user_id")
def latest_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("q"), F.lit("").alias("situation"))
    return latest_requests(events)


#: What a kind of event asks for, and where.
ASKED = {"view": ("red wiget", ""), "error": ("bolt", "Brand#11"), "purchase": ("smal promo gear", ""), "signup": ("विदगेत", "Brand#11"), "click": (" ", "")}
_ASKED_SQL = ", ".join(f"({sql.quoted(k)}, {sql.quoted(q)}, {sql.quoted(s)})" for k, (q, s) in ASKED.items())
_FOUND_SQL = " UNION ALL ".join(
    f"SELECT {sql.quoted(q)} AS q, {sql.quoted(s)} AS situation, idx, score, hindi FROM ({sql.scored(q)})" + (f" WHERE situation = {sql.quoted(s)}" if s else "") for q, s in ASKED.values() if q.strip()
)


_ANSWERS_SQL = (
    f"WITH {sql.KEYED}, latest AS (SELECT user_id AS session, max(event_id) AS seq, max_by(event_type, event_id) AS kind FROM events GROUP BY user_id), asked AS (SELECT * FROM (VALUES {_ASKED_SQL}) t(kind, q, situation)), "
    f"found AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {sql.ORDER}) AS rank FROM ({_FOUND_SQL})) "
    "SELECT session, seq, q AS query, situation AS asked, idx, round(score, 9) AS score, rank FROM latest JOIN asked USING (kind) JOIN found USING (q, situation) WHERE rank <= 5"
)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    pick = lambda i: reduce(lambda c, k: c.when(kind == k, ASKED[k][i]), ASKED, F.when(F.lit(False), ""))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), pick(0).alias("q"), pick(1).alias("situation"))


_ANSWERED = ("session", "seq", "query", "asked", "idx", "score", "rank")


@query(_ANSWERS_SQL)
def session_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the ranking for each session's latest request, within the situation it names."""
    found = rounded(answer(keyed(spark, sf_dir), _requests(spark, sf_dir), 5))
    return found.withColumn("rank", F.col("rank").cast("long")).select(*_ANSWERED)


@query(_ANSWERS_SQL)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: requests are read from a folder, answers go to a table."""
    path = scratch(spark)
    _requests(spark, sf_dir).write.parquet(f"{path}/requests")
    asked = spark.readStream.schema(spark.read.parquet(f"{path}/requests").schema).parquet(f"{path}/requests")
    sink = lambda found, n: found.withColumn("rank", F.col("rank").cast("long")).select(*_ANSWERED).write.mode("append").parquet(f"{path}/answers")
    stream = search_stream(asked, keyed(spark, sf_dir), sink, f"{path}/progress", 5)
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return rounded(spark.read.parquet(f"{path}/answers"))
