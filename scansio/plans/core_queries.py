"""Queries of the core operators over whole tables, and their SQL.

Searches take as queries every transcript or vector whose id is divisible by 100, against all verses or vectors; `match_single`,
`match_span`, `match_eval` and `match_hinted` take all transcripts. Texts
whose edit distance SQL must reproduce are folded to ASCII first, since DuckDB's distance counts bytes; the operators
themselves count characters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scansio.functions import score as sc
from scansio.functions import signal as sg
from scansio.functions import text as tx
from scansio.operators import corpus as cp
from scansio.operators import decoding as dc
from scansio.operators import evaluation as ev
from scansio.operators import layout as ly
from scansio.operators import matching as mt
from scansio.operators import neighbours as nb
from scansio.operators import sequence as sq
from scansio.operators.dedup import one_per_id
from scansio.session import cut, load
from scansio.streaming import tracker

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Arabic letters and the ASCII letters they are folded to.
FOLD_FROM = "ابتثجحخدذرزسشصضطظعغفقكلمنهويءؤئةىأإآٱ"
FOLD_TO = "ABTCJHKDVRZSXcdtzEGFQkLMNhwyOoIeiaubw"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _verses(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "verses")


def _messages(s: SparkSession, d: str) -> DataFrame:
    return sq.messages(load(s, d, "messages"))


def folded(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), "[^A-Za-z ]", "q")


# --- SQL that several queries share -----------------------------------------------------------------------------------

_hex = lambda ranges: re.sub(r"\\u(\w{4})", r"\\x{\1}", ranges)  # noqa: E731  (the same ranges as DuckDB writes them)
_DIA = _hex(tx.DIACRITICS)
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _norm(x: str) -> str:
    united = f"translate(regexp_replace(replace(translate({x}, '{tx.WORD_START}', ' '), '﻿', ''), '[{_DIA}]', '', 'g'), '{tx.VARIANTS}{tx.DROPPED[1:]}', '{tx.UNITED}')"
    return f"trim(regexp_replace({united}, '{_WS}', ' ', 'g'))"


def _fold(x: str) -> str:
    return f"regexp_replace(translate({x}, '{FOLD_FROM}', '{FOLD_TO}'), '[^A-Za-z ]', 'q', 'g')"


def _ratio(a: str, b: str) -> str:
    n = f"(length({a}) + length({b}))"
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE ({n} - levenshtein({a}, {b}))::DOUBLE / {n} END"


_SOURCE = "coalesce(nullif(text_clean, ''), text_uthmani, '')"
_ONE = "(SELECT DISTINCT ON (verse_id) * FROM verses WHERE verse_id IS NOT NULL ORDER BY verse_id)"
_CUT = f"trim(CASE WHEN strpos(norm, '{tx.OPENING}') > 0 THEN substr(norm, 1, strpos(norm, '{tx.OPENING}') - 1) || substr(norm, strpos(norm, '{tx.OPENING}') + {len(tx.OPENING)}) ELSE norm END)"
CORPUS = f"""(SELECT *, replace(norm, ' ', '') AS ns, CASE WHEN ayah = 1 AND surah NOT IN (1, 9) THEN nullif({_CUT}, '') END AS no_bsm, string_split(norm, ' ') AS words FROM
    (SELECT verse_id, edition AS book, surah, ayah, text_uthmani, surah_name, surah_name_en, {_norm(_SOURCE)} AS norm,
        (row_number() OVER (PARTITION BY edition ORDER BY surah, ayah) - 1)::INT AS idx
    FROM {_ONE} WHERE edition IS NOT NULL AND surah IS NOT NULL AND ayah IS NOT NULL))"""
MESSAGES = """(SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1)::INT AS pos FROM
    (SELECT DISTINCT ON (session_id, seq) * FROM messages WHERE session_id IS NOT NULL AND seq IS NOT NULL ORDER BY session_id, seq, msg_id))"""
MATCHES = f"(SELECT *, surah || ':' || ayah AS ref FROM {MESSAGES} WHERE msg_type = 'verse_match' AND surah IS NOT NULL AND ayah IS NOT NULL)"
PROGRESS = f"(SELECT *, surah || ':' || ayah AS ref FROM {MESSAGES} WHERE msg_type = 'word_progress' AND surah IS NOT NULL AND ayah IS NOT NULL)"
_R3 = lambda x, n=3: f"floor(({x}) * {10**n}.0 + 0.5) / {10**n}.0"

# --- text ---------------------------------------------------------------------------------------------------------------


@query("norm_text", f"SELECT verse_id, norm, ns, no_bsm, replace(no_bsm, ' ', '') AS no_bsm_ns FROM {CORPUS}")
def _(s, d):
    return cp.build(_verses(s, d)).select("verse_id", "norm", "ns", "no_bsm", "no_bsm_ns")


@query("tokenize_words", f"SELECT verse_id, unnest(range(len(words)))::INT AS pos, unnest(words) AS word FROM {CORPUS}")
def _(s, d):
    return cp.build(_verses(s, d)).select("verse_id", F.posexplode("words").alias("pos", "word"))


_LIGHT = f"trim(regexp_replace(translate(regexp_replace(text_uthmani, '[{_DIA}]', '', 'g'), '{tx.VARIANTS}ـ', '{tx.UNITED}'), '{_WS}', ' ', 'g'))"
_DISPLAY = f"translate(regexp_replace(text_uthmani, '[{_DIA}]', '', 'g'), 'أإآٱ', 'اااا')"


@query("text_variants", f"SELECT verse_id, {_LIGHT} AS light, {_DISPLAY} AS display, starts_with({_DISPLAY}, '{tx.OPENING}') AS opens, substr(text_uthmani, 1, 60) AS preview, regexp_replace(text_uthmani, '[{_DIA}]', '', 'g') AS bare FROM {_ONE}")
def _(s, d):
    v, c = one_per_id(_verses(s, d), "verse_id", "text_uthmani"), F.col("text_uthmani")
    return v.select("verse_id", tx.normalize_light(c).alias("light"), tx.normalize_display(c).alias("display"), tx.starts_with_opening(c).alias("opens"), tx.preview(c).alias("preview"), tx.strip_diacritics(c).alias("bare"))


@query("display_words", f"SELECT verse_id, unnest(string_split(regexp_replace(text_uthmani, ' ([{_hex(tx.PAUSE_MARKS)}]{{1,2}})( |$)', chr(1) || '\\1\\2', 'g'), ' ')) AS w FROM {_ONE} WHERE text_uthmani IS NOT NULL".replace("AS w FROM", "AS raw FROM").join(("SELECT verse_id, replace(raw, chr(1), ' ') AS word FROM (", ")")))
def _(s, d):
    v = one_per_id(_verses(s, d), "verse_id", "text_uthmani")
    return v.select("verse_id", F.explode(tx.display_words(F.col("text_uthmani"))).alias("word"))


@query("trigram_index", f"SELECT tri, count(*) AS verses FROM (SELECT DISTINCT book, idx, substr(ns, p, 3) AS tri FROM (SELECT book, idx, ns, unnest(range(1, length(ns) - 1)) AS p FROM {CORPUS} WHERE length(ns) >= 3)) GROUP BY tri")
def _(s, d):
    return cp.trigram_index(cp.build(_verses(s, d))).groupBy("tri").agg(F.count(F.lit(1)).alias("verses"))


@query("labels", f"""SELECT msg_id, surah || ':' || ayah AS ref, CASE WHEN confidence >= 0.7 THEN 'good' WHEN confidence >= 0.4 THEN 'warn' ELSE 'error' END AS band, {_R3("confidence", 2)} AS c2,
    lpad((surah * 10)::VARCHAR, 3, '0') AS page, translate(ayah::VARCHAR, '0123456789', '{tx.ARABIC_DIGITS}') AS arabic FROM messages WHERE msg_type = 'verse_match' AND surah IS NOT NULL AND ayah IS NOT NULL""")
def _(s, d):
    m, c = load(s, d, "messages").where("msg_type = 'verse_match' AND surah IS NOT NULL AND ayah IS NOT NULL"), F.col
    return m.select("msg_id", tx.verse_key(c("surah"), c("ayah")).alias("ref"), tx.confidence_band(c("confidence")).alias("band"), tx.rounded(c("confidence"), 2).alias("c2"), tx.page_name(c("surah") * 10).alias("page"), tx.arabic_number(c("ayah")).alias("arabic"))


@query("trigger_labels", "SELECT diag_id, CASE trigger_name WHEN 'surah_jump' THEN 'Surah jump' WHEN 'rapid_switching' THEN 'Rapid switching' ELSE trigger_name END AS label, len(events)::INT AS n_events FROM (SELECT DISTINCT ON (diag_id) * FROM diagnostics ORDER BY diag_id)")
def _(s, d):
    x = one_per_id(load(s, d, "diagnostics"), "diag_id", "trigger_name", "events")
    return x.select("diag_id", tx.trigger_label(F.col("trigger_name")).alias("label"), F.when(F.col("events").isNotNull(), F.size("events")).alias("n_events"))


# --- scores -------------------------------------------------------------------------------------------------------------


def _pairs(s, d) -> DataFrame:
    """Each verse with the next of its book, folded."""
    c = cp.build(_verses(s, d)).select("verse_id", "book", "idx", folded(F.col("norm")).alias("a"))
    return c.withColumn("b", F.lead("a").over(Window.partitionBy("book").orderBy("idx"))).where("b IS NOT NULL").select("verse_id", "a", "b")


_PAIRS = f"(SELECT * FROM (SELECT verse_id, a, lead(a) OVER (PARTITION BY book ORDER BY idx) AS b FROM (SELECT verse_id, book, idx, {_fold('norm')} AS a FROM {CORPUS})) WHERE b IS NOT NULL)"
_PLACES = f"(SELECT verse_id, pos::INT AS pos, aw[pos + 1] AS a, bw[pos + 1] AS b FROM (SELECT *, unnest(range(least(len(aw), len(bw)))) AS pos FROM (SELECT verse_id, string_split(a, ' ') AS aw, string_split(b, ' ') AS bw FROM {_PAIRS})))"


def _places(s, d) -> DataFrame:
    """The words of both texts at every place that both have."""
    zipped = F.posexplode(F.arrays_zip(F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))).alias("pos", "w")
    return _pairs(s, d).select("verse_id", zipped).select("verse_id", "pos", "w.a", "w.b").where("a IS NOT NULL AND b IS NOT NULL")


@query("lev_ratio_pairs", f"SELECT verse_id, levenshtein(a, b)::INT AS distance, {_R3(_ratio('a', 'b'))} AS ratio FROM {_PAIRS}")
def _(s, d):
    return _pairs(s, d).select("verse_id", F.levenshtein("a", "b").alias("distance"), tx.rounded(sc.ratio(F.col("a"), F.col("b")), 3).alias("ratio"))


@query("fragment_score_pairs", f"""SELECT verse_id, pos, min(x)::INT AS distance, {_R3("CASE WHEN length(any_value(a)) = 0 THEN 1.0 ELSE greatest(0.0, 1 - min(x)::DOUBLE / length(any_value(a))) END")} AS fragment FROM
    (SELECT verse_id, pos, a, least(length(a), levenshtein(a, substr(b, p, n))) AS x FROM (SELECT *, unnest(range(0, length(b) - p + 2)) AS n FROM (SELECT *, unnest(range(1, length(b) + 2)) AS p FROM {_PLACES}))) GROUP BY verse_id, pos""")
def _(s, d):
    """Every word of a text within the word at its place of the next."""
    w = _places(s, d).repartition(s.sparkContext.defaultParallelism, "verse_id")
    return w.select("verse_id", "pos", sc.semi_global(F.col("a"), F.col("b")).alias("distance"), tx.rounded(sc.fragment(F.col("a"), F.col("b")), 3).alias("fragment"))


@query("shared_prefix", f"""SELECT verse_id, coalesce(min(CASE WHEN x <> y THEN i END), least(max(n), max(m)))::BIGINT AS shared FROM
    (SELECT verse_id, n, m, i, aw[i + 1] AS x, bw[i + 1] AS y FROM (SELECT *, len(aw) AS n, len(bw) AS m, unnest(range(least(len(aw), len(bw)))) AS i FROM (SELECT verse_id, string_split(a, ' ') AS aw, string_split(b, ' ') AS bw FROM {_PAIRS}))) GROUP BY verse_id""")
def _(s, d):
    return _pairs(s, d).select("verse_id", tx.shared_prefix(F.split("a", " "), F.split("b", " ")).alias("shared"))


@query("suffix_prefix", f"""SELECT verse_id, {_R3("max(r)")} AS best FROM (SELECT verse_id, 0.0 AS r FROM {_PAIRS} UNION ALL
    SELECT verse_id, {_ratio('u', 'v')} FROM (SELECT verse_id, array_to_string(t[k + 1:], ' ') AS u, array_to_string(w[1:least(len(t) - k, len(w))], ' ') AS v FROM
    (SELECT *, unnest(range(1, least(len(t) // 2, 4) + 1)) AS k FROM (SELECT verse_id, string_split(a, ' ') AS t, string_split(b, ' ') AS w FROM {_PAIRS}) WHERE len(t) >= 2 AND len(w) >= 2))) GROUP BY verse_id""")
def _(s, d):
    return _pairs(s, d).select("verse_id", tx.rounded(sc.suffix_prefix(F.split("a", " "), F.split("b", " ")), 3).alias("best"))


@query("window_match")
def _(s, d):
    p = _pairs(s, d).repartition(s.sparkContext.defaultParallelism, "verse_id").select("verse_id", sc.window_match(F.split("a", " "), F.split("b", " ")).alias("m"))
    return p.select("verse_id", tx.rounded(F.col("m.score"), 3).alias("score"), "m.start", "m.end")


# Scores over whole texts.


@query("word_match_places", f"""SELECT verse_id, pos::INT AS pos, {_R3(f"CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE {_ratio('a', 'b')} END")} AS similarity, a = b OR (length(a) > 2 AND length(b) > 2 AND {_ratio('a', 'b')} >= 0.7) AS matches FROM
    (SELECT verse_id, pos, aw[pos + 1] AS a, bw[pos + 1] AS b FROM (SELECT *, unnest(range(greatest(len(aw), len(bw)))) AS pos FROM (SELECT verse_id, string_split(a, ' ') AS aw, string_split(b, ' ') AS bw FROM {_PAIRS}))) WHERE a IS NOT NULL AND b IS NOT NULL
    UNION ALL SELECT verse_id, unnest(range(least(n, m), greatest(n, m)))::INT, NULL, NULL FROM (SELECT verse_id, len(string_split(a, ' ')) AS n, len(string_split(b, ' ')) AS m FROM {_PAIRS})""")
def _(s, d):
    """Every place of either text; null where only one of them has a word."""
    a, b = F.col("w.a"), F.col("w.b")
    p = _pairs(s, d).select("verse_id", F.posexplode(F.arrays_zip(F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))).alias("pos", "w"))
    there = a.isNotNull() & b.isNotNull()
    return p.select("verse_id", "pos", F.when(there, tx.rounded(sc.word_similarity(a, b), 3)).alias("similarity"), F.when(there, sc.words_match(a, b)).alias("matches"))


_SHORT_TEXT = f"(SELECT verse_id, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM {_PAIRS})"


@query("partial_ratio_texts", f"SELECT verse_id, {_R3('max(r)')} AS best FROM (SELECT verse_id, CASE WHEN s = '' THEN 0.0 ELSE {_ratio('s', 'w')} END AS r FROM (SELECT verse_id, s, substr(l, p, length(s)) AS w FROM (SELECT *, unnest(range(1, length(l) - length(s) + 2)) AS p FROM {_SHORT_TEXT}))) GROUP BY verse_id")
def _(s, d):
    p = _pairs(s, d).repartition(s.sparkContext.defaultParallelism, "verse_id")
    return p.select("verse_id", tx.rounded(sc.partial_ratio(F.col("a"), F.col("b")), 3).alias("best"))


@query("fragment_score_texts")
def _(s, d):
    p = _pairs(s, d).repartition(s.sparkContext.defaultParallelism, "verse_id")
    return p.select("verse_id", sc.semi_global(F.col("a"), F.col("b")).alias("distance"), tx.rounded(sc.fragment(F.col("a"), F.col("b")), 3).alias("fragment"))


@query("align_words")
def _(s, d):
    p = _pairs(s, d).repartition(s.sparkContext.defaultParallelism, "verse_id")
    return p.select("verse_id", F.explode_outer(sc.align(F.split("a", " "), F.split("b", " "))).alias("place"))


# --- retrieval ----------------------------------------------------------------------------------------------------------


def _corpus(s, d) -> DataFrame:
    """The corpus with its derived columns, written once: matching reads it in several places."""
    return cut(cp.build(_verses(s, d)))


def _verses_of(s, d) -> DataFrame:
    """The corpus for matching, written once without what matching doesn't read."""
    return cp.stored(cp.build(_verses(s, d)))


def _transcripts(s, d) -> DataFrame:
    """Every transcript."""
    return load(s, d, "messages").where("msg_type = 'raw_transcript'").select(F.col("msg_id").alias("qid"), "text")


def _asked(s, d) -> DataFrame:
    """The stated query set of the searches that don't take all: every hundredth transcript."""
    return _transcripts(s, d).where("qid % 100 = 0")


_ASKED = f"(SELECT qid, q, replace(q, ' ', '') AS qns FROM (SELECT msg_id AS qid, {_norm('text')} AS q FROM messages WHERE msg_type = 'raw_transcript' AND msg_id % 100 = 0) WHERE length(replace(q, ' ', '')) >= 3)"


@query("trigram_topk", f"""WITH t AS (SELECT DISTINCT book, idx, substr(ns, p, 3) AS tri FROM (SELECT book, idx, ns, unnest(range(1, length(ns) - 1)) AS p FROM {CORPUS} WHERE length(ns) >= 3)),
    q AS (SELECT qid, tri, row_number() OVER (PARTITION BY qid ORDER BY f) - 1 AS pos FROM (SELECT qid, tri, min(p) AS f FROM (SELECT qid, substr(qns, p, 3) AS tri, p FROM (SELECT qid, qns, unnest(range(1, length(qns) - 1)) AS p FROM {_ASKED})) GROUP BY qid, tri)),
    h AS (SELECT qid, book, idx, count(*) AS hits, min(pos) AS first FROM t JOIN q USING (tri) GROUP BY ALL)
    SELECT qid, book, idx, hits, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, first, book, idx) AS rank FROM h) WHERE rank <= 200""")
def _(s, d):
    return mt.candidates(mt.prepare(_asked(s, d)), _verses_of(s, d), 200)


@query("full_search_topk", f"""SELECT qid, book, idx, {_R3("score")} AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, book, idx) AS place FROM
    (SELECT qid, book, idx, {_ratio('q', 'n')} AS score FROM (SELECT qid, {_fold('q')} AS q FROM {_ASKED} WHERE length(replace({_fold('q')}, ' ', '')) >= 3), (SELECT book, idx, {_fold('norm')} AS n FROM {CORPUS}))) WHERE place <= 5""")
def _(s, d):
    c = cp.build(_verses(s, d)).withColumn("norm", folded(F.col("norm")))
    asked = _asked(s, d).withColumn("text", folded(tx.normalize(F.col("text"))))
    return mt.search(asked, c).withColumn("score", tx.rounded(F.col("score"), 3))


def _rounded_match(m: DataFrame) -> DataFrame:
    return m.select("qid", "book", "surah", "ayah", "ayah_end", tx.rounded(F.col("score"), 3).alias("score"), tx.rounded(F.col("raw"), 3).alias("raw"), "bonus")


@query("match_single")
def _(s, d):
    prepared, same = mt.once(mt.prepare(_transcripts(s, d)))
    got = mt.score_candidates(prepared, _verses_of(s, d), mt.PRODUCT)
    return mt.given(got.where("place <= 10").withColumns({"total": tx.rounded(F.col("total"), 3), "raw": tx.rounded(F.col("raw"), 3)}).drop("best"), same)


@query("match_span")
def _(s, d):
    return _rounded_match(mt.match(_transcripts(s, d), _verses_of(s, d)))


@query("match_eval")
def _(s, d):
    return _rounded_match(mt.match(_transcripts(s, d), _verses_of(s, d), mt.EVAL3))


def _after_matches(s, d) -> DataFrame:
    """Every transcript with the reference of the last match before it in its session."""
    h = sq.with_last_match(_messages(s, d), "raw_transcript")
    return h.select(F.col("msg_id").alias("qid"), "text", F.col("last_surah").alias("hint_surah"), F.col("last_ayah").alias("hint_ayah"))


def _hinted(s, d) -> DataFrame:
    """The stated transcripts of those."""
    return _after_matches(s, d).where("qid % 100 = 0")


@query("match_hinted")
def _(s, d):
    return _rounded_match(mt.match(_after_matches(s, d), _verses_of(s, d)))


@query("match_narrow")
def _(s, d):
    return _rounded_match(mt.match_narrow(_hinted(s, d), _verses_of(s, d)))


@query("next_verse", f"""WITH c AS (SELECT book, surah, ayah FROM {CORPUS}), f AS (SELECT book, surah, min(ayah) AS f FROM c GROUP BY ALL)
    SELECT c.book, c.surah, c.ayah, CASE WHEN n.ayah IS NOT NULL THEN c.surah WHEN f.f IS NOT NULL THEN c.surah + 1 END AS next_surah, coalesce(n.ayah, f.f) AS next_ayah
    FROM c LEFT JOIN c n ON n.book = c.book AND n.surah = c.surah AND n.ayah = c.ayah + 1 LEFT JOIN f ON f.book = c.book AND f.surah = c.surah + 1""")
def _(s, d):
    return cp.successors(cp.base(_verses(s, d)))


@query("surrounding_context", f"SELECT a.book, a.surah, a.ayah, b.ayah AS near_ayah, b.text_uthmani AS text, a.ayah = b.ayah AS is_current FROM {CORPUS} a JOIN {CORPUS} b ON a.book = b.book AND a.surah = b.surah AND abs(a.ayah - b.ayah) <= 2")
def _(s, d):
    c = cp.base(_verses(s, d))
    return cp.surrounding(c, c)


_HINTS = f"""(SELECT * FROM (SELECT msg_id, msg_type, last_value(CASE WHEN msg_type = 'verse_match' AND surah IS NOT NULL AND ayah IS NOT NULL THEN {{'s': surah, 'a': ayah}} END IGNORE NULLS)
    OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM {MESSAGES}) WHERE msg_type = 'raw_transcript' AND msg_id % 100 = 0 AND h IS NOT NULL)"""


@query("continuation_bonus", f"""WITH c AS (SELECT book, surah, ayah, row_number() OVER (PARTITION BY book, surah ORDER BY ayah) - 1 AS i FROM {CORPUS}), h AS (SELECT msg_id AS qid, h.s AS hs, h.a AS ha FROM {_HINTS}),
    b AS (SELECT * FROM (VALUES (0, 0.22::DOUBLE), (1, 0.12), (2, 0.06)) t(k, bonus)), f AS (SELECT qid, book FROM h JOIN c ON c.surah = hs AND c.ayah = ha + 1)
    SELECT qid, c.book, c.surah, c.ayah, bonus FROM h JOIN b ON true JOIN c ON c.surah = hs AND c.ayah = ha + 1 + k SEMI JOIN f ON f.qid = h.qid AND f.book = c.book
    UNION ALL SELECT qid, c.book, c.surah, c.ayah, bonus FROM h JOIN b ON true JOIN c ON c.surah = hs + 1 AND c.i = k ANTI JOIN f ON f.qid = h.qid AND f.book = c.book""")
def _(s, d):
    return cp.continuation_bonuses(_hinted(s, d), cp.base(_verses(s, d)))


@query("verse_lookup", f"SELECT m.msg_id, v.book, v.text_uthmani FROM (SELECT msg_id, surah, ayah FROM messages WHERE msg_type = 'verse_match') m JOIN {CORPUS} v USING (surah, ayah)")
def _(s, d):
    m = load(s, d, "messages").where("msg_type = 'verse_match'").select("msg_id", "surah", "ayah")
    return m.join(cp.base(_verses(s, d)).select("book", "surah", "ayah", "text_uthmani"), ["surah", "ayah"]).select("msg_id", "book", "text_uthmani")


@query("surah_view", f"SELECT book, surah, min(surah_name) AS surah_name, min(surah_name_en) AS surah_name_en, count(*) AS n_verses, string_agg(ayah::VARCHAR, ',' ORDER BY ayah) AS ayahs FROM {CORPUS} GROUP BY ALL")
def _(s, d):
    v = cp.surah_view(cp.base(_verses(s, d)))
    return v.select("book", "surah", "surah_name", "surah_name_en", "n_verses", F.array_join(F.transform("verses", lambda x: x["ayah"].cast("string")), ",").alias("ayahs"))


_FORMS = f"(SELECT DISTINCT book, idx, form FROM (SELECT book, idx, norm AS form FROM {CORPUS} UNION ALL SELECT book, idx, no_bsm FROM {CORPUS}) WHERE form <> '')"


@query("equiv_groups", f"SELECT form, count(*) AS verses FROM {_FORMS} GROUP BY form HAVING count(*) > 1")
def _(s, d):
    return cp.equivalence_groups(cp.build(_verses(s, d)))


@query("equiv_stats", f"SELECT count(*) AS groups, coalesce(sum(verses), 0)::BIGINT AS duplicate_verses, coalesce(max(verses), 0) AS largest FROM (SELECT form, count(*) AS verses FROM {_FORMS} GROUP BY form HAVING count(*) > 1)")
def _(s, d):
    return cp.equivalence_stats(cp.build(_verses(s, d)))


@query("corpus_totals", f"SELECT book, count(*) AS verses, count(DISTINCT surah) AS surahs FROM {CORPUS} GROUP BY book")
def _(s, d):
    return cp.base(_verses(s, d)).groupBy("book").agg(F.count(F.lit(1)).alias("verses"), F.countDistinct("surah").alias("surahs"))


@query("embedding_topk", f"""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    SELECT query, vec_id, {_R3("cosine", 4)} AS cosine, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM
    (SELECT q.vec_id AS query, u.vec_id, list_cosine_similarity(q.e, u.e) AS cosine FROM u q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 100 = 0)) WHERE place <= 10""")
def _(s, d):
    e = load(s, d, "embeddings")
    return nb.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding").withColumn("cosine", tx.rounded(F.col("cosine"), 4))


# --- evaluation ---------------------------------------------------------------------------------------------------------


def _predictions(s, d) -> DataFrame:
    """The first match of any session to each sample's surah stands for a recogniser's answer, and how long it was on its way
    for the time it took."""
    took = F.unix_millis(F.col("arrived_at").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))
    first = load(s, d, "messages").where("msg_type = 'verse_match' AND surah IS NOT NULL AND ayah IS NOT NULL").groupBy("surah").agg(F.min_by(F.struct("ayah", "confidence", took.alias("time_ms")), "msg_id").alias("m"))
    return load(s, d, "benchmark_samples").select(F.col("sample_id").alias("qid"), "surah").join(first, "surah").select("qid", "surah", F.col("m.ayah").alias("ayah"), (F.col("m.ayah") + 1).alias("ayah_end"), F.col("m.confidence").alias("score"), F.col("m.time_ms").alias("time_ms"))


def _folded_corpus(s, d) -> DataFrame:
    c = cp.build(_verses(s, d)).withColumns({"norm": folded(F.col("norm")), "no_bsm": folded(F.col("no_bsm"))})
    return c.withColumns({"ns": tx.no_spaces(F.col("norm")), "no_bsm_ns": tx.no_spaces(F.col("no_bsm")), "words": tx.words(F.col("norm"))})


def _equivalents(s, d) -> DataFrame:
    c = _folded_corpus(s, d)
    return cp.equivalent_refs(c).unionByName(ev.similar_refs(load(s, d, "benchmark_samples"), _predictions(s, d), c)).distinct()


_EQ_FORMS = f"(SELECT DISTINCT book, surah, ayah, form FROM (SELECT book, surah, ayah, {_fold('norm')} AS form FROM {CORPUS} UNION ALL SELECT book, surah, ayah, {_fold('no_bsm')} FROM {CORPUS}) WHERE form <> '')"
_EQ_TEXT = f"(SELECT book, surah, ayah, replace({_fold('coalesce(no_bsm, norm)')}, ' ', '') AS x FROM {CORPUS})"
_PRED = "(SELECT sample_id AS qid, surah, m.ayah AS p_ayah, m.ayah + 1 AS p_end, m.t AS time_ms FROM benchmark_samples JOIN (SELECT surah, min_by({'ayah': ayah, 't': epoch_us(arrived_at) // 1000 - epoch_us(ts) // 1000}, msg_id) AS m FROM messages WHERE msg_type = 'verse_match' AND surah IS NOT NULL AND ayah IS NOT NULL GROUP BY surah) USING (surah))"
_ASKED_REFS = f"(SELECT DISTINCT s.surah, s.ayah, p_ayah AS other_ayah FROM (SELECT sample_id, unnest(expected_verses).surah AS surah, unnest(expected_verses).ayah AS ayah FROM benchmark_samples) s JOIN {_PRED} p ON p.qid = s.sample_id AND p.surah = s.surah WHERE s.ayah <> p_ayah)"
_EQ = f"""(SELECT DISTINCT a.surah, a.ayah, b.ayah AS other_ayah FROM {_EQ_FORMS} a JOIN {_EQ_FORMS} b ON a.book = b.book AND a.surah = b.surah AND a.form = b.form AND a.ayah <> b.ayah
    UNION SELECT r.surah, r.ayah, r.other_ayah FROM {_ASKED_REFS} r JOIN {_EQ_TEXT} a ON a.surah = r.surah AND a.ayah = r.ayah JOIN {_EQ_TEXT} b ON b.book = a.book AND b.surah = r.surah AND b.ayah = r.other_ayah WHERE {_ratio('a.x', 'b.x')} > 0.95)"""
_CLASS = f"""(SELECT s.sample_id AS qid, category, source, e.surah AS surah, e.ayah AS ayah, CASE WHEN p_ayah IS NULL THEN 'no_match' WHEN e.surah = p.surah AND e.ayah BETWEEN p_ayah AND p_end THEN 'exact' WHEN e.surah = p.surah AND eq.surah IS NOT NULL THEN 'equivalent'
    WHEN e.surah = p.surah AND abs(e.ayah - p_ayah) <= 1 THEN 'within1' WHEN e.surah = p.surah AND abs(e.ayah - p_ayah) <= 2 THEN 'within2' WHEN e.surah = p.surah THEN 'same_surah' ELSE 'wrong' END AS class, time_ms
    FROM (SELECT *, expected_verses[1] AS e FROM benchmark_samples WHERE len(expected_verses) > 0) s LEFT JOIN {_PRED} p ON p.qid = s.sample_id LEFT JOIN {_EQ} eq ON eq.surah = e.surah AND eq.ayah = e.ayah AND eq.other_ayah = p_ayah)"""


@query("equivalent_refs", f"SELECT *, surah AS other_surah FROM {_EQ}")
def _(s, d):
    return _equivalents(s, d)


@query("eval_five", f"""SELECT sample_id AS qid, category, source, ['correct', 'equiv', 'adjacent', 'wrong', 'no_match'][min(r) + 1] AS class FROM (SELECT s.*, CASE WHEN p.qid IS NULL THEN 4 WHEN s.surah <> p.surah THEN 3 WHEN s.ayah BETWEEN p_ayah AND p_end THEN 0
    WHEN eq.surah IS NOT NULL THEN 1 WHEN abs(s.ayah - p_ayah) <= 1 OR abs(s.ayah - p_end) <= 1 THEN 2 ELSE 3 END AS r FROM (SELECT sample_id, category, source, unnest(expected_verses).surah AS surah, unnest(expected_verses).ayah AS ayah FROM benchmark_samples) s
    LEFT JOIN {_PRED} p ON p.qid = s.sample_id LEFT JOIN {_EQ} eq ON eq.surah = s.surah AND eq.ayah = s.ayah AND eq.other_ayah = p_ayah) GROUP BY ALL""")
def _(s, d):
    return ev.classify_five(load(s, d, "benchmark_samples"), _predictions(s, d), _equivalents(s, d))


def _classified(s, d) -> DataFrame:
    return ev.classify(load(s, d, "benchmark_samples"), _predictions(s, d), _equivalents(s, d))


@query("eval_classify", f"SELECT * FROM {_CLASS}")
def _(s, d):
    return _classified(s, d)


_EXACT = "avg((class = 'exact')::INT)"
_LENIENT = "('exact', 'equivalent', 'within1', 'within2')"


@query("eval_by_category", f"SELECT category, count(*) AS n, {_R3(_EXACT, 4)} AS exact, {_R3(f'avg((class IN {_LENIENT})::INT)', 4)} AS lenient, {_R3('avg(time_ms)')} AS avg_ms FROM {_CLASS} GROUP BY ROLLUP (category)")
def _(s, d):
    return ev.accuracy(_classified(s, d), "category").withColumns({n: tx.rounded(F.col(n), k) for n, k in (("exact", 4), ("lenient", 4), ("avg_ms", 3))})


@query("eval_by_source", f"SELECT source, count(*) AS n, {_R3(f'avg((class IN {_LENIENT})::INT)', 4)} AS lenient FROM {_CLASS} GROUP BY ROLLUP (source)")
def _(s, d):
    return ev.accuracy(_classified(s, d), "source").select("source", "n", tx.rounded(F.col("lenient"), 4).alias("lenient"))


@query("eval_class_table", f"SELECT category, {', '.join(f"count(*) FILTER (class = '{k}') AS {k}" for k in ev.CLASSES)} FROM {_CLASS} GROUP BY category")
def _(s, d):
    return ev.class_table(_classified(s, d), "category")


@query("eval_by_band", f"SELECT CASE WHEN surah >= 78 THEN '78+' WHEN surah >= 11 THEN '11-77' ELSE '1-10' END AS band, count(*) AS n, count(*) FILTER (class = 'exact') AS exact FROM {_CLASS} GROUP BY ALL")
def _(s, d):
    return _classified(s, d).groupBy(ev.surah_band(F.col("surah")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == "exact").alias("exact"))


@query("span_coverage", f"SELECT s.sample_id AS qid, count(*) AS n, count(*) FILTER (e.surah = p.surah AND e.ayah BETWEEN p_ayah AND p_end) AS covered FROM (SELECT sample_id, unnest(expected_verses) AS e FROM benchmark_samples) s LEFT JOIN {_PRED} p ON p.qid = s.sample_id GROUP BY ALL")
def _(s, d):
    return ev.span_coverage(load(s, d, "benchmark_samples"), _predictions(s, d))


def _expected(s, d) -> DataFrame:
    """Every session expects the first ten verses of the first surahs in which it makes progress."""
    return sq.progress(_messages(s, d)).where("ayah <= 10").select("session_id", "surah", "ayah").distinct()


_EXPECTED = f"(SELECT DISTINCT session_id, surah, ayah FROM {PROGRESS} WHERE ayah <= 10)"


@query("first_matches", f"SELECT e.session_id, e.surah, e.ayah, min(m.seq) AS first_seq FROM {_EXPECTED} e LEFT JOIN {MATCHES} m USING (session_id, surah, ayah) GROUP BY ALL")
def _(s, d):
    return ev.first_matches(_expected(s, d), _messages(s, d))


@query("unexpected_matches", f"SELECT m.session_id, m.surah, m.ayah, m.seq FROM {MATCHES} m ANTI JOIN {_EXPECTED} e USING (session_id, surah, ayah)")
def _(s, d):
    return ev.unexpected_matches(_expected(s, d), sq.matches(_messages(s, d)))


# --- streams of messages ------------------------------------------------------------------------------------------------


@query("event_histogram", f"SELECT msg_type, count(*) AS n FROM {MESSAGES} GROUP BY msg_type")
def _(s, d):
    return sq.type_counts(_messages(s, d))


@query("distinct_refs", f"SELECT session_id, count(DISTINCT ref) AS refs FROM {MATCHES} GROUP BY session_id")
def _(s, d):
    return sq.distinct_refs(_messages(s, d))


@query("oscillation", f"SELECT session_id, a AS from_ref, b AS to_ref, count(*) AS n FROM (SELECT session_id, ref, lag(ref, 1) OVER w AS b, lag(ref, 2) OVER w AS a FROM {MATCHES} WINDOW w AS (PARTITION BY session_id ORDER BY seq)) WHERE ref = a AND ref <> b GROUP BY ALL")
def _(s, d):
    return sq.oscillation(_messages(s, d))


@query("monotonicity", f"SELECT session_id, ref, pos, max_seen, word_index FROM (SELECT *, max(word_index) OVER (PARTITION BY session_id, ref ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_seen FROM {PROGRESS}) WHERE word_index < max_seen")
def _(s, d):
    return sq.regressions(_messages(s, d))


@query("order_monotone", f"SELECT session_id, coalesce(bool_and(ok), true) AS in_order FROM (SELECT session_id, surah = lag(surah) OVER w AND ayah >= lag(ayah) OVER w AS ok FROM {MATCHES} WINDOW w AS (PARTITION BY session_id ORDER BY seq)) GROUP BY ALL")
def _(s, d):
    return sq.in_order(_messages(s, d))


@query("discovery_latency", f"SELECT session_id, coalesce(min(pos) FILTER (msg_type = 'verse_match' AND surah IS NOT NULL AND ayah IS NOT NULL), -1) AS first_match FROM {MESSAGES} GROUP BY ALL")
def _(s, d):
    return sq.latency(_messages(s, d))


@query("settles", f"SELECT session_id, count(*) <= 2 OR count(DISTINCT ref) <= 1 AS settled FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS b FROM {MATCHES}) WHERE b <= 3 GROUP BY session_id")
def _(s, d):
    return sq.settles(_messages(s, d))


@query("match_changes", f"SELECT session_id, seq, ref FROM (SELECT *, lag(ref) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM {MATCHES}) WHERE prev IS NULL OR prev <> ref")
def _(s, d):
    return sq.changes(_messages(s, d))


@query("top_relative", f"""SELECT session_id, seq, confidence, {_R3("confidence / nullif(top, 0)")} AS share, CASE WHEN top > 0 AND confidence / top >= 0.97 THEN 'top' WHEN top > 0 AND confidence / top >= 0.85 THEN 'likely' ELSE 'other' END AS band
    FROM (SELECT *, max(confidence) OVER (PARTITION BY session_id) AS top FROM {MATCHES}) WHERE confidence IS NOT NULL""")
def _(s, d):
    return sq.top_relative(_messages(s, d))


TRIGGERS = f"""(SELECT * FROM (SELECT session_id, seq, ms, CASE WHEN prev <> surah THEN 'surah_jump' WHEN refs >= 3 THEN 'rapid_switching' END AS trigger FROM
    (SELECT *, lag(surah) OVER (PARTITION BY session_id ORDER BY seq) AS prev, count(DISTINCT ref) OVER (PARTITION BY session_id ORDER BY ms RANGE BETWEEN 9999 PRECEDING AND CURRENT ROW) AS refs FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM {MATCHES} WHERE ts IS NOT NULL))) WHERE trigger IS NOT NULL)"""


@query("rapid_switching", f"SELECT * FROM {TRIGGERS}")
def _(s, d):
    return sq.triggers(_messages(s, d))


@query("cooldown_events", f"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ms, seq, trigger) AS n FROM {TRIGGERS}),
    r AS (SELECT *, true AS send, ms AS last FROM t WHERE n = 1 UNION ALL SELECT t.*, t.ms - r.last >= 30000, CASE WHEN t.ms - r.last >= 30000 THEN t.ms ELSE r.last END FROM r JOIN t ON t.session_id = r.session_id AND t.n = r.n + 1)
    SELECT session_id, seq, ms, trigger FROM r WHERE send""")
def _(s, d):
    return sq.cooled_down(sq.triggers(_messages(s, d)))


@query("ring_last_50", f"SELECT session_id, seq, msg_type, back::INT AS back FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM {MESSAGES}) WHERE back <= 50")
def _(s, d):
    return sq.newest(_messages(s, d))


@query("last_transcripts", f"SELECT session_id, seq, text, back::INT AS back FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM {MESSAGES} WHERE msg_type = 'raw_transcript') WHERE back <= 5")
def _(s, d):
    return sq.last_transcripts(_messages(s, d))


_RUNS = f"""(SELECT session_id, ref, run::BIGINT AS run, list_sort(list_distinct(flatten(list(matched_indices) FILTER (matched_indices IS NOT NULL)))) AS indices, max_by(total_words, seq) AS total, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS run_ms FROM
    (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN lag(ref) OVER (PARTITION BY session_id ORDER BY seq) = ref THEN 0 ELSE 1 END AS new FROM {PROGRESS})) GROUP BY ALL)"""
_PREFIX_OF = f"(SELECT *, (coalesce((SELECT min(i) FROM range(0, len(coalesce(indices, [])) + 1) t(i) WHERE NOT list_contains(coalesce(indices, []), i)), 0) - 1)::INT AS prefix FROM {_RUNS})"


@query("contiguous_prefix", f"SELECT session_id, ref, run, total, prefix FROM {_PREFIX_OF}")
def _(s, d):
    r = sq.covered_words(_messages(s, d))
    return r.select("session_id", "ref", "run", "total", sq.contiguous_prefix(F.col("indices")).alias("prefix"))


@query("skipped_words", f"""SELECT session_id, ref, run, unnest(range(prefix + 1, list_min(beyond))) AS word FROM (SELECT *, list_filter(indices, lambda x: x > prefix + 1) AS beyond FROM {_PREFIX_OF}) WHERE prefix >= 1 AND len(beyond) >= 2 AND coalesce(run_ms >= {sq.GRACE_MS}, true)""")
def _(s, d):
    r = sq.covered_words(_messages(s, d)).withColumn("prefix", sq.contiguous_prefix(F.col("indices")))
    return r.select("session_id", "ref", "run", F.explode(sq.skipped(F.col("indices"), F.col("prefix"), since_ms=F.col("run_ms")).cast("array<bigint>")).alias("word"))


@query("word_coverage", f"""SELECT session_id, ref, coalesce(words, 0) AS words, total, {_R3("CASE WHEN total > 0 THEN least(coalesce(words, 0) / total, 1.0) END", 4)} AS coverage FROM
    (SELECT session_id, ref, max_by(total_words, seq) AS total FROM {PROGRESS} GROUP BY ALL) LEFT JOIN (SELECT session_id, ref, count(DISTINCT i) AS words FROM (SELECT session_id, ref, unnest(matched_indices) AS i FROM {PROGRESS}) GROUP BY ALL) USING (session_id, ref)""")
def _(s, d):
    return sq.word_coverage(_messages(s, d)).withColumn("coverage", tx.rounded(F.col("coverage"), 4))


@query("scenario_rollup", f"""SELECT scenario, count(*) AS verses, count(*) FILTER (discovered) AS discovered, {_R3("avg(discovered::INT)", 4)} AS discovery_rate, {_R3("avg(CASE WHEN total > 0 THEN coalesce(words, 0) / total END)", 4)} AS coverage, {_R3("avg(ms)")} AS avg_ms, sum(ms)::BIGINT AS sum_ms FROM
    (SELECT p.surah AS scenario, m.ref IS NOT NULL AS discovered, total, words, ms FROM (SELECT session_id, surah, ref, max_by(total_words, seq) AS total, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS ms FROM {PROGRESS} GROUP BY ALL) p
    LEFT JOIN (SELECT session_id, ref, count(DISTINCT i) AS words FROM (SELECT session_id, ref, unnest(matched_indices) AS i FROM {PROGRESS}) GROUP BY ALL) USING (session_id, ref) LEFT JOIN (SELECT DISTINCT session_id, ref FROM {MATCHES}) m USING (session_id, ref)) GROUP BY scenario""")
def _(s, d):
    m = _messages(s, d)
    hit = sq.matches(m).select("session_id", "ref", F.lit(True).alias("discovered")).distinct()
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    took = sq.progress(m).groupBy("session_id", "ref").agg((F.max(ms) - F.min(ms)).alias("time_ms"))
    rows = sq.word_coverage(m).join(hit, ["session_id", "ref"], "left").join(took, ["session_id", "ref"]).select("time_ms", tx.key_part(F.col("ref"), 0).alias("scenario"), F.coalesce("discovered", F.lit(False)).alias("discovered"), F.col("words").alias("words_covered"), F.col("total").alias("words_total"))
    return ev.scenario_rollup(rows).withColumns({n: tx.rounded(F.col(n), k) for n, k in (("discovery_rate", 4), ("coverage", 4), ("avg_ms", 3))})


@query("criteria", f"""SELECT 'order' AS scenario, count(*) FILTER (pass) AS passed, count(*) AS n, bool_and(pass) AS all_pass, bool_or(pass) AS any_pass FROM
    (SELECT session_id, coalesce(bool_and(ok), true) AS pass FROM (SELECT session_id, surah = lag(surah) OVER w AND ayah >= lag(ayah) OVER w AS ok FROM {MATCHES} WINDOW w AS (PARTITION BY session_id ORDER BY seq)) GROUP BY ALL)
    UNION ALL SELECT 'settled', count(*) FILTER (pass), count(*), bool_and(pass), bool_or(pass) FROM (SELECT session_id, count(*) <= 2 OR count(DISTINCT ref) <= 1 AS pass FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS b FROM {MATCHES}) WHERE b <= 3 GROUP BY session_id)""")
def _(s, d):
    m = _messages(s, d)
    rows = sq.in_order(m).select(F.lit("order").alias("scenario"), F.col("in_order").alias("pass")).unionByName(sq.settles(m).select(F.lit("settled").alias("scenario"), F.col("settled").alias("pass")))
    return ev.criteria(rows)


@query("stream_tracker")
def _(s, d):
    """Transcripts as chunks of two seconds each, followed in every book."""
    chunks = _messages(s, d).where("msg_type = 'raw_transcript'").select("session_id", "seq", F.lit(tracker.SEEK_CYCLE).alias("n_samples"), F.lit(0.1).alias("level"), "text")
    return tracker.track_books(chunks, _corpus(s, d)).select("book", "session_id", "seq", "n", "type", "surah", "ayah", "confidence", "word_index", "total_words")


# --- time windows, reports, signals -------------------------------------------------------------------------------------


@query("sliding_rms", """SELECT start, event_type, count(*) AS n, floor(sqrt(avg(value * value)) * 1000.0 + 0.5) / 1000.0 AS rms FROM
    (SELECT event_type, value, time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS start FROM events, range(4) t(k)) GROUP BY ALL""")
def _(s, d):
    e = load(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    w = e.groupBy(F.window("ts", "1 hour", "15 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), tx.rounded(F.sqrt(F.avg(F.col("value") * F.col("value"))), 3).alias("rms"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "rms")


@query("session_silence", """SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run""")
def _(s, d):
    e = load(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    w = e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


@query("count_window", """SELECT user_id, event_id, floor(sqrt(avg(value * value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) * 1000.0 + 0.5) / 1000.0 AS rms FROM events""")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return load(s, d, "events").select("user_id", "event_id", tx.rounded(F.sqrt(F.avg(F.col("value") * F.col("value")).over(w)), 3).alias("rms"))


@query("newest_first", "SELECT report_id, sent_at FROM (SELECT DISTINCT ON (report_id) report_id, sent_at FROM reports ORDER BY report_id) ORDER BY sent_at DESC NULLS LAST, report_id LIMIT 100")
def _(s, d):
    return one_per_id(load(s, d, "reports"), "report_id", "sent_at").orderBy(F.desc_nulls_last("sent_at"), "report_id").limit(100)


@query("report_counts", "SELECT surah, count(*) AS n, count(*) FILTER (audio_size_bytes > 0) AS with_audio, max(sent_at) AS newest FROM (SELECT DISTINCT ON (report_id) * FROM reports ORDER BY report_id) GROUP BY surah")
def _(s, d):
    r = one_per_id(load(s, d, "reports"), "report_id", "surah", "audio_size_bytes", "sent_at")
    return r.groupBy("surah").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("audio_size_bytes") > 0).alias("with_audio"), F.max("sent_at").alias("newest"))


@query("sample_rms", f"SELECT vec_id, {_R3('sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / len(embedding))')} AS rms, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / len(embedding)) < 0.005 AS silent, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / len(embedding)) > 0.01 AS sounds, list_sum(list_transform(embedding, lambda x: trunc(CASE WHEN x < 0 THEN greatest(x::DOUBLE, -1.0) * 32768 ELSE least(x::DOUBLE, 1.0) * 32767 END)::BIGINT))::BIGINT AS int_sum, len(embedding[-16:])::INT AS tail FROM embeddings")
def _(s, d):
    e, x = load(s, d, "embeddings"), F.col("embedding")
    total = F.aggregate(sg.to_int16(x), F.lit(0).cast("long"), lambda a, v: a + v)
    return e.select("vec_id", tx.rounded(sg.rms(x), 3).alias("rms"), sg.is_silence(x).alias("silent"), sg.is_sound(x).alias("sounds"), total.alias("int_sum"), F.size(sg.tail(x, 16)).alias("tail"))


# --- layouts ------------------------------------------------------------------------------------------------------------

_PAGES = "(SELECT DISTINCT ON (page_id) page_id, edition, page, lines FROM mushaf_pages WHERE page_id IS NOT NULL ORDER BY page_id)"
_PLACED = f"""(SELECT page_id, edition, page, outer_pos, inner_pos, try_cast(split_part(w.location, ':', 1) AS INT) AS surah, try_cast(split_part(w.location, ':', 2) AS INT) AS ayah, try_cast(split_part(w.location, ':', 3) AS INT) AS w, w.word AS word FROM
    (SELECT page_id, edition, page, outer_pos, unnest(range(len(l.words)))::INT AS inner_pos, unnest(l.words) AS w FROM (SELECT page_id, edition, page, unnest(range(len(lines)))::INT AS outer_pos, unnest(lines) AS l FROM {_PAGES})) WHERE w.location IS NOT NULL)"""
_PAGE_VERSES = f"(SELECT page_id, edition, page, surah, ayah, (row_number() OVER (PARTITION BY page_id ORDER BY o, i) - 1)::INT AS place FROM (SELECT page_id, edition, page, surah, ayah, min(outer_pos) AS o, min_by(inner_pos, outer_pos * 100000 + inner_pos) AS i FROM {_PLACED} GROUP BY ALL))"


@query("page_verses", f"SELECT * FROM {_PAGE_VERSES}")
def _(s, d):
    return ly.page_verses(load(s, d, "mushaf_pages"))


@query("verse_pages", f"SELECT edition, surah, ayah, min(page) AS page FROM {_PLACED} GROUP BY ALL")
def _(s, d):
    return ly.verse_pages(load(s, d, "mushaf_pages"))


@query("verse_words", f"SELECT edition, surah, ayah, w, min(word) AS word FROM {_PLACED} GROUP BY ALL")
def _(s, d):
    return ly.verse_words(load(s, d, "mushaf_pages"))


@query("prior_verses", f"""SELECT v.page_id, v.surah, v.ayah, v.place FROM {_PAGE_VERSES} v JOIN (SELECT page_id, max(place) AS upto FROM {_PAGE_VERSES} GROUP BY page_id) USING (page_id) WHERE place < upto AND place % 2 = 1""")
def _(s, d):
    p = load(s, d, "mushaf_pages")
    v = ly.page_verses(p)
    last = v.groupBy("page_id").agg(F.max_by(F.struct("surah", "ayah"), "place").alias("m")).select("page_id", "m.surah", "m.ayah")
    return ly.prior_verses(p, last, v.where("place % 2 = 0"))


@query("first_on_page", f"""SELECT session_id, edition, seq, page, coalesce(lag(page) OVER (PARTITION BY session_id, edition ORDER BY seq) <> page, true) AS first FROM {MATCHES} JOIN (SELECT edition, surah, ayah, min(page) AS page FROM {_PLACED} GROUP BY ALL) USING (surah, ayah)""")
def _(s, d):
    return sq.first_on_page(_messages(s, d), ly.verse_pages(load(s, d, "mushaf_pages")))


@query("surah_list", f"SELECT book, surah, surah_name, (row_number() OVER (PARTITION BY book ORDER BY idx) - 1)::INT AS place FROM (SELECT book, surah, min(idx) AS idx, arg_min(surah_name, idx) AS surah_name FROM (SELECT book, surah, idx, surah_name FROM {CORPUS} QUALIFY row_number() OVER (PARTITION BY book, surah ORDER BY idx) = 1) GROUP BY book, surah)")
def _(s, d):
    return cp.surah_list(cp.base(_verses(s, d)))


_LETTERS = ", ".join(map(str, mt.LETTER_SURAHS))


@query("short_candidates", f"""SELECT n::INT AS n, book, idx FROM (SELECT *, count(*) FILTER (near) OVER (PARTITION BY n, book) AS found FROM
    (SELECT n, book, idx, coalesce(length(ns) <= n + 5 OR (ayah = 1 AND surah IN ({_LETTERS})) OR length(replace(no_bsm, ' ', '')) <= n + 5, false) AS near FROM {CORPUS}, range(3) t(n))) WHERE near OR found < 20""")
def _(s, d):
    return mt.short_candidates(cp.build(_verses(s, d)))


@query("clips_for", """SELECT scenario, (row_number() OVER (PARTITION BY scenario ORDER BY pos) - 1)::INT AS place, surah, ayah, file FROM (SELECT sample_id AS scenario, unnest(range(len(expected_verses))) AS pos, unnest(expected_verses).surah AS surah, unnest(expected_verses).ayah AS ayah FROM benchmark_samples)
    JOIN (SELECT surah, ayah, min(file) AS file FROM benchmark_samples WHERE ayah_end IS NULL GROUP BY ALL) USING (surah, ayah)""")
def _(s, d):
    b = load(s, d, "benchmark_samples")
    return ev.clips_for(ev.expected_rows(b).withColumnRenamed("qid", "scenario"), b.where("ayah_end IS NULL"))


# --- several answers to one question ----------------------------------------------------------------------------------------

_ANSWERS = f"(SELECT session_id AS qid, seq AS hyp, surah, ayah, confidence AS score FROM {MATCHES} WHERE confidence IS NOT NULL)"


def _answers(s, d) -> DataFrame:
    """The matches of a session as hypotheses in their order."""
    return sq.matches(_messages(s, d)).where("confidence IS NOT NULL").select(F.col("session_id").alias("qid"), F.col("seq").alias("hyp"), "surah", "ayah", F.lit(None).cast("int").alias("ayah_end"), F.col("confidence").alias("score"))


@query("best_hypothesis", f"SELECT qid, hyp, surah, ayah, score FROM {_ANSWERS} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, hyp) = 1")
def _(s, d):
    return dc.best_hypothesis(_answers(s, d)).drop("ayah_end")


_FIRST = f"(SELECT * FROM {_ANSWERS} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hyp) = 1)"
_LAST = f"(SELECT * FROM {_ANSWERS} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hyp DESC) = 1)"


def _first_last(s, d) -> tuple[DataFrame, DataFrame]:
    """The first and the last match of a session stand for a cheap and a costly pass."""
    answers = _answers(s, d)
    one = lambda pick: answers.groupBy("qid").agg(pick(F.struct("hyp", "surah", "ayah", "ayah_end", "score"), "hyp").alias("m")).select("qid", "m.*")
    return one(F.min_by), one(F.max_by)


@query("better_of", f"SELECT qid, CASE WHEN b THEN l.surah ELSE f.surah END AS surah, CASE WHEN b THEN l.ayah ELSE f.ayah END AS ayah, CASE WHEN b THEN l.score ELSE f.score END AS score FROM (SELECT *, f.score < 0.85 AND l.score > f.score + 0.05 AS b FROM {_FIRST} f JOIN {_LAST} l USING (qid))".replace("SELECT *, f.score", "SELECT qid, f, l, f.score"))
def _(s, d):
    return ev.better_of(*_first_last(s, d)).drop("ayah_end")


@query("gated", f"SELECT qid, surah, ayah, score FROM {_FIRST} WHERE score >= 0.7 UNION ALL SELECT l.qid, l.surah, l.ayah, l.score FROM {_LAST} l JOIN {_FIRST} f USING (qid) WHERE f.score < 0.7")
def _(s, d):
    first, last = _first_last(s, d)
    return dc.gated(first, lambda low: last.join(low.select("qid"), "qid", "left_semi").select(first.columns)).select("qid", "surah", "ayah", "score")


@query("full_clip", """SELECT c.file, c.type, c.surah, c.ayah, f.file AS full_file FROM (SELECT file, CASE source WHEN 'everyayah' THEN 'full' ELSE 'first60' END AS type, surah, ayah FROM benchmark_samples) c
    LEFT JOIN (SELECT surah, ayah, min(file) AS file FROM benchmark_samples WHERE source = 'everyayah' GROUP BY ALL) f ON f.surah = c.surah AND f.ayah = c.ayah WHERE c.type <> 'full'""")
def _(s, d):
    kind = F.when(F.col("source") == "everyayah", "full").otherwise("first60")
    return ev.full_clip(load(s, d, "benchmark_samples").select("file", kind.alias("type"), "surah", "ayah"))


@query("idle_detection", f"""SELECT session_id, least(q, e)::BIGINT AS idle_at, q > e AS timed_out FROM (SELECT session_id, min(CASE WHEN nx IS NULL OR nx - ms >= 1500 THEN ms + 1500 END) AS q, min(ms) + 60000 AS e FROM
    (SELECT session_id, ms, lead(ms) OVER (PARTITION BY session_id ORDER BY ms, seq) AS nx FROM (SELECT session_id, seq, epoch_us(ts) // 1000 AS ms FROM {MESSAGES} WHERE ts IS NOT NULL)) GROUP BY session_id)""")
def _(s, d):
    return sq.idle(_messages(s, d))


@query("equiv_members", f"SELECT form, book, idx FROM {_FORMS} QUALIFY count(*) OVER (PARTITION BY form) > 1")
def _(s, d):
    return cp.equivalence_members(cp.build(_verses(s, d)))


@query("last_match_before", f"""SELECT msg_id, h.s AS last_surah, h.a AS last_ayah FROM (SELECT msg_id, msg_type, last_value(CASE WHEN msg_type = 'verse_match' AND surah IS NOT NULL AND ayah IS NOT NULL THEN {{'s': surah, 'a': ayah}} END IGNORE NULLS)
    OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM {MESSAGES}) WHERE msg_type = 'raw_transcript'""")
def _(s, d):
    return sq.with_last_match(_messages(s, d), "raw_transcript").select("msg_id", "last_surah", "last_ayah")
