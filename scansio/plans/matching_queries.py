"""Matching over texts folded to ASCII, with SQL that scores, ranks and chooses anew from the definitions.

The operators are those of `match_*`; only the letters differ, as DuckDB's edit distance counts bytes. Queries are the
stated transcripts, of `runners_up_ascii` all, against all verses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.functions import text as tx
from scansio.operators import corpus as cp
from scansio.operators import matching as mt
from scansio.plans import core_queries as cq
from scansio.plans.core_queries import _HINTS, _PAIRS, _R3, CORPUS, MESSAGES, _fold, _norm, _ratio, folded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _corpus(s, d) -> DataFrame:
    """The corpus with its letters folded, written once."""
    return cp.stored(cq._folded_corpus(s, d))


def _folded_text(asked: DataFrame) -> DataFrame:
    return asked.withColumn("text", folded(tx.normalize(F.col("text"))))


# --- SQL ----------------------------------------------------------------------------------------------------------------

_C = f"""c AS MATERIALIZED (SELECT book, idx, surah, ayah, norm, replace(norm, ' ', '') AS ns, nb, replace(nb, ' ', '') AS nbns, string_split(norm, ' ') AS words, string_split(nb, ' ') AS nbwords FROM
    (SELECT book, idx, surah, ayah, {_fold("norm")} AS norm, {_fold("no_bsm")} AS nb FROM {CORPUS}))"""
_q = lambda source, some=" AND msg_id % 100 = 0": f"""q AS MATERIALIZED (SELECT qid, q, replace(q, ' ', '') AS qns, string_split(q, ' ') AS t, len(string_split(q, ' ')) AS n FROM
    (SELECT msg_id AS qid, {_fold(_norm("text"))} AS q FROM {source} WHERE msg_type = 'raw_transcript'{some}) WHERE length(replace(q, ' ', '')) >= 3)"""  # noqa: E731
_Q, _HINTED_Q, _EVERY_Q = _q("messages"), _q(MESSAGES), _q("messages", "")
_FOUND = """tri AS (SELECT DISTINCT book, idx, substr(ns, p, 3) AS tri FROM (SELECT book, idx, ns, unnest(range(1, length(ns) - 1)) AS p FROM c WHERE length(ns) >= 3)),
    qt AS (SELECT qid, tri, row_number() OVER (PARTITION BY qid ORDER BY f) - 1 AS pos FROM (SELECT qid, tri, min(p) AS f FROM (SELECT qid, substr(qns, p, 3) AS tri, p FROM (SELECT qid, qns, unnest(range(1, length(qns) - 1)) AS p FROM q)) GROUP BY qid, tri)),
    found AS MATERIALIZED (SELECT qid, book, idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, first, book, idx) AS rank FROM
        (SELECT qid, book, idx, count(*) AS hits, min(pos) AS first FROM tri JOIN qt USING (tri) GROUP BY ALL)) WHERE rank <= 200)"""
_BONUS = f"""b AS MATERIALIZED (WITH cs AS (SELECT book, surah, ayah, idx, row_number() OVER (PARTITION BY book, surah ORDER BY ayah) - 1 AS i FROM c), h AS (SELECT msg_id AS qid, h.s AS hs, h.a AS ha FROM {_HINTS}),
    k AS (SELECT * FROM (VALUES (0, 0.22::DOUBLE), (1, 0.12), (2, 0.06)) t(k, bonus)), f AS (SELECT qid, book FROM h JOIN cs ON cs.surah = hs AND cs.ayah = ha + 1)
    SELECT qid, cs.book, cs.surah, cs.ayah, cs.idx, bonus FROM h JOIN k ON true JOIN cs ON cs.surah = hs AND cs.ayah = ha + 1 + k SEMI JOIN f ON f.qid = h.qid AND f.book = cs.book
    UNION ALL SELECT qid, cs.book, cs.surah, cs.ayah, cs.idx, bonus FROM h JOIN k ON true JOIN cs ON cs.surah = hs + 1 AND cs.i = k ANTI JOIN f ON f.qid = h.qid AND f.book = cs.book)"""


def _runs(words: str, condition: str, column: str) -> str:
    """The best ratio of the whole text with runs of one word less or more of `words`, and the best run of as many words by
    its words: 0.6 x share of matching words + 0.4 x mean similarity."""
    sim = f"CASE WHEN x = y THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE {_ratio('x', 'y')} END"
    sized = " UNION ALL ".join(
        f"SELECT qid, book, idx, {_ratio('q', 'w')} AS s FROM (SELECT qid, book, idx, q, array_to_string({words}[st + 1:st + n {d}], ' ') AS w FROM (SELECT *, unnest(range(0, len({words}) - (n {d}) + 1)) AS st FROM p WHERE {condition} AND n {d} >= 1))" for d in ("- 1", "+ 1")
    )
    return f"""{column} AS MATERIALIZED (SELECT qid, book, idx, max(s) AS s FROM (
        SELECT qid, book, idx, 0.6 * (sum((sim >= 0.7)::INT) / any_value(n)) + 0.4 * (sum(sim) / any_value(n)) AS s FROM
            (SELECT qid, book, idx, st, n, {sim} AS sim FROM (SELECT qid, book, idx, st, n, t[k + 1] AS x, {words}[st + k + 1] AS y FROM
                (SELECT *, unnest(range(n)) AS k FROM (SELECT *, unnest(range(0, len({words}) - n + 1)) AS st FROM p WHERE {condition})))) GROUP BY qid, book, idx, st
        UNION ALL {sized}) GROUP BY qid, book, idx)"""


def _fragments(verse: str, condition: str, column: str) -> str:
    """1 - the least distance to any stretch / length: no stretch beyond twice the length is nearer than the empty one."""
    return f"""{column} AS MATERIALIZED (SELECT qns AS fq, v AS fv, greatest(0.0, 1 - least(min(length(qns)), min(levenshtein(qns, substr(v, st, k))))::DOUBLE / length(qns)) AS s FROM
        (SELECT qns, v, st, unnest(range(1, least(2 * length(qns), length(v) - st + 1) + 1)) AS k FROM (SELECT *, unnest(range(1, length(v) + 1)) AS st FROM (SELECT DISTINCT qns, {verse} AS v FROM p WHERE {condition}))) GROUP BY qns, v)"""


_FEWER = "n >= 2 AND len(words) >= 5 AND n < len(words) * 0.8"
_SLIDES = "n >= 2 AND len(words) >= 5 AND length(qns) < length(ns) * 0.8"
_SUFFIX = f"""sp AS MATERIALIZED (SELECT qid, book, idx, max(r) AS s FROM (SELECT qid, book, idx, 0.0 AS r FROM p WHERE bonus > 0 UNION ALL
    SELECT qid, book, idx, {_ratio("u", "v")} FROM (SELECT qid, book, idx, array_to_string(t[k + 1:], ' ') AS u, array_to_string(words[1:least(n - k, len(words))], ' ') AS v FROM
        (SELECT *, unnest(range(1, least(n // 2, 4) + 1)) AS k FROM p WHERE bonus > 0 AND n >= 2 AND len(words) >= 2))) GROUP BY qid, book, idx)"""


def _smart(v: str, frag: str) -> str:
    r = _ratio("qns", v)
    return f"CASE WHEN {v} IS NULL OR length({v}) = 0 THEN NULL WHEN length(qns) / length({v}) < 0.7 THEN greatest({frag}, 0.6 * {frag} + 0.4 * ({r})) ELSE {r} END"


_NB = f"CASE WHEN nb IS NOT NULL THEN {_ratio('q', 'nb')} END"
#: `scored` of pairs `p` of transcripts and verses with bonus and rank.
_SCORED = f"""{_fragments("ns", "length(qns) < 0.85 * length(ns)", "f1")}, {_fragments("nbns", "length(qns) < 0.7 * length(nbns)", "f2")},
    {_runs("words", _FEWER, "w1")}, {_runs("nbwords", f"{_FEWER} AND nb IS NOT NULL AND len(nbwords) >= 3", "w2")},
    sl AS MATERIALIZED (SELECT qid, book, idx, max({_ratio("q", "w")}) AS s FROM (SELECT qid, book, idx, q, array_to_string(words[st + 1:st + n + 1], ' ') AS w FROM
        (SELECT *, unnest(range(0, len(words) - least(n, len(words)) + 1)) AS st FROM p WHERE {_SLIDES})) GROUP BY qid, book, idx), {_SUFFIX},
    scored AS MATERIALIZED (SELECT *, least(raw + bonus, 1.0) AS total FROM (SELECT p.*, greatest({_smart("ns", "coalesce(f1.s, 0.0)")}, {_smart("nbns", "coalesce(f2.s, 0.0)")}, {_ratio("q", "norm")}, {_NB}, coalesce(w1.s, 0.0) * 0.95, coalesce(w2.s, 0.0) * 0.95,
        greatest(coalesce(sl.s, 0.0), CASE WHEN {_SLIDES} AND length(qns) >= 5 AND length(qns) < length(ns) * 0.85 THEN coalesce(f1.s, 0.0) ELSE 0.0 END) * 0.92, sp.s) AS raw
        FROM p LEFT JOIN f1 ON f1.fq = p.qns AND f1.fv = p.ns LEFT JOIN f2 ON f2.fq = p.qns AND f2.fv = p.nbns LEFT JOIN w1 USING (qid, book, idx) LEFT JOIN w2 USING (qid, book, idx) LEFT JOIN sl USING (qid, book, idx) LEFT JOIN sp USING (qid, book, idx)))"""
_RANKED = """ranked AS MATERIALIZED (SELECT *, first_value(total) OVER w AS best, row_number() OVER w AS place FROM (SELECT *, (total > max(total) OVER (PARTITION BY qid) - 0.001)::INT AS near, abs(length(ns) - length(qns)) AS diff FROM scored)
    WINDOW w AS (PARTITION BY qid ORDER BY near DESC, CASE WHEN near = 1 THEN diff END NULLS FIRST, total DESC, diff, rank, book, idx))"""
_PLAIN_PAIRS = "p AS MATERIALIZED (SELECT q.*, c.*, found.rank, 0.0::DOUBLE AS bonus FROM found JOIN q USING (qid) JOIN c USING (book, idx))"
_HINT_PAIRS = f"""{_BONUS}, p AS MATERIALIZED (SELECT q.*, c.*, x.rank, x.bonus FROM (SELECT coalesce(f.qid, b.qid) AS qid, coalesce(f.book, b.book) AS book, coalesce(f.idx, b.idx) AS idx, coalesce(f.rank, 1000000) AS rank, coalesce(b.bonus, 0.0::DOUBLE) AS bonus
    FROM found f FULL JOIN b ON f.qid = b.qid AND f.book = b.book AND f.idx = b.idx) x JOIN q ON q.qid = x.qid JOIN c ON c.book = x.book AND c.idx = x.idx)"""


def _chosen(bonus: str, join: str) -> str:
    """The best single or run of two or three verses of the surahs of the twenty best singles."""
    lead = lambda k, x: f"lead({x}, {k}) OVER w"
    return f"""r0 AS (SELECT book, surah, idx AS start, ayah, coalesce(nb, norm) AS head, {lead(1, "norm")} AS n1, {lead(1, "ayah")} AS a1, {lead(2, "norm")} AS n2, {lead(2, "ayah")} AS a2 FROM c WINDOW w AS (PARTITION BY book, surah ORDER BY idx)),
    r AS (SELECT book, surah, start, ayah, 2 AS k, a1 AS ayah_end, head || ' ' || n1 AS run FROM r0 WHERE n1 IS NOT NULL UNION ALL SELECT book, surah, start, ayah, 3, a2, head || ' ' || n1 || ' ' || n2 FROM r0 WHERE n2 IS NOT NULL),
    g AS (SELECT qid, book, surah, min(place) AS g, any_value(best) AS best FROM ranked WHERE place <= 20 GROUP BY ALL),
    runs AS (SELECT qid, book, surah, ayah, ayah_end, {_ratio("q", "run")} AS raw, bonus, g, start, k FROM (SELECT g.qid, g.book, g.surah, r.ayah, r.ayah_end, r.run, r.start, r.k, g.g, g.best, q.q, {bonus} AS bonus FROM g JOIN r USING (book, surah) JOIN q ON q.qid = g.qid {join})
        WHERE 2 * least(length(q), length(run)) / (length(q) + length(run)) + bonus > best),
    chosen AS (SELECT qid, m.* FROM (SELECT qid, arg_max({{'book': book, 'surah': surah, 'ayah': ayah, 'ayah_end': ayah_end, 'score': score, 'raw': raw, 'bonus': bonus}}, o) AS m FROM (
        SELECT qid, book, surah, ayah, NULL::INT AS ayah_end, total AS score, raw, bonus, [total, 0, 0, 0, 0] AS o FROM ranked WHERE place = 1
        UNION ALL SELECT qid, book, surah, ayah, ayah_end, least(raw + bonus, 1.0), raw, bonus, [least(raw + bonus, 1.0), -1, -g, -start, -k] FROM runs) GROUP BY qid) WHERE m.score >= 0.3)
    SELECT qid, book, surah, ayah, ayah_end, {_R3("score")} AS score, {_R3("raw")} AS raw, bonus FROM chosen"""


def _put(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


_SINGLE = f"SELECT qid, book, idx, surah, ayah, {_R3('raw')} AS raw, bonus, {_R3('total')} AS total, place::INT AS place FROM ranked WHERE place <= 10"


@_put("match_single_ascii", f"WITH {_C}, {_Q}, {_FOUND}, {_PLAIN_PAIRS}, {_SCORED}, {_RANKED} {_SINGLE}")
def _(s, d):
    return _singles(mt.score_candidates(mt.prepare(_folded_text(cq._asked(s, d))), _corpus(s, d), mt.PRODUCT))


def _singles(got: DataFrame) -> DataFrame:
    return got.where("place <= 10").withColumns({"total": tx.rounded(F.col("total"), 3), "raw": tx.rounded(F.col("raw"), 3)}).drop("best")


@_put("match_hinted_single_ascii", f"WITH {_C}, {_HINTED_Q}, {_FOUND}, {_HINT_PAIRS}, {_SCORED}, {_RANKED} {_SINGLE}")
def _(s, d):
    return _singles(mt.score_candidates(mt.prepare(_folded_text(cq._hinted(s, d))), _corpus(s, d), mt.PRODUCT))


@_put("match_span_ascii", f"WITH {_C}, {_Q}, {_FOUND}, {_PLAIN_PAIRS}, {_SCORED}, {_RANKED}, {_chosen('0.0::DOUBLE', '')}")
def _(s, d):
    return cq._rounded_match(mt.match(_folded_text(cq._asked(s, d)), _corpus(s, d)))


@_put("match_hinted_ascii", f"WITH {_C}, {_HINTED_Q}, {_FOUND}, {_HINT_PAIRS}, {_SCORED}, {_RANKED}, {_chosen('coalesce(b.bonus, 0.0)', 'LEFT JOIN b ON b.qid = g.qid AND b.book = g.book AND b.surah = g.surah AND b.ayah = r.ayah')}")
def _(s, d):
    return cq._rounded_match(mt.match(_folded_text(cq._hinted(s, d)), _corpus(s, d)))


_NEAR_PAIRS = f"""{_BONUS}, hs AS (SELECT msg_id AS qid, h.s AS hs, h.a AS ha FROM {_HINTS}), near AS (SELECT hs.qid, c.book, c.idx AS hat, c.surah AS hsurah FROM hs JOIN c ON c.surah = hs.hs AND c.ayah = hs.ha),
    p AS MATERIALIZED (SELECT q.*, c.*, CASE WHEN c.idx >= hat THEN c.idx - hat ELSE 8 + c.idx - hat END AS rank, coalesce(b.bonus, 0.0::DOUBLE) AS bonus FROM near JOIN c ON c.book = near.book AND c.idx BETWEEN hat - 2 AND hat + 5 AND (c.idx >= hat OR c.surah = hsurah)
        JOIN q ON q.qid = near.qid LEFT JOIN b ON b.qid = near.qid AND b.book = c.book AND b.idx = c.idx)"""


@_put("match_near_ascii", f"WITH {_C}, {_HINTED_Q.replace('>= 3', '>= 1')}, {_NEAR_PAIRS}, {_SCORED} SELECT qid, book, surah, ayah, NULL::INT AS ayah_end, {_R3('total')} AS score, {_R3('raw')} AS raw, bonus FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY total DESC, rank, book) AS best FROM scored) WHERE best = 1 AND total >= 0.35")
def _(s, d):
    return cq._rounded_match(mt.match_near(_folded_text(cq._hinted(s, d)), _corpus(s, d)))


# --- words of a verse against the next ------------------------------------------------------------------------------------

_W = f"(SELECT verse_id, string_split(a, ' ') AS t, string_split(b, ' ') AS v, a FROM {_PAIRS})"
_SIM = f"CASE WHEN x = y THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE {_ratio('x', 'y')} END"
_WINDOWS = f"""SELECT verse_id, CASE WHEN s > 0 THEN {_R3("s")} ELSE 0.0 END AS score FROM (SELECT verse_id, coalesce(max(s), 0.0) AS s FROM (
    SELECT verse_id, 0.0 AS s FROM {_W} UNION ALL
    SELECT verse_id, 0.6 * (sum((sim >= 0.7)::INT) / any_value(n)) + 0.4 * (sum(sim) / any_value(n)) FROM (SELECT verse_id, st, n, {_SIM} AS sim FROM (SELECT verse_id, st, len(t) AS n, t[k + 1] AS x, v[st + k + 1] AS y FROM
        (SELECT *, unnest(range(len(t))) AS k FROM (SELECT *, unnest(range(0, len(v) - len(t) + 1)) AS st FROM {_W})))) GROUP BY verse_id, st
    UNION ALL SELECT verse_id, {_ratio("a", "w")} FROM (SELECT verse_id, a, array_to_string(v[st + 1:st + m], ' ') AS w FROM (SELECT *, unnest(range(0, len(v) - m + 1)) AS st FROM (SELECT *, len(t) + unnest([-1, 1]) AS m FROM {_W}) WHERE m >= 1))) GROUP BY verse_id)"""
_ALIGN = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT * FROM {_W}), m AS (SELECT verse_id, k, j FROM (SELECT verse_id, k, j, t[k + 1] AS x, v[j + 1] AS y FROM (SELECT *, unnest(range(len(v))) AS j FROM (SELECT *, unnest(range(len(t))) AS k FROM w)))
        WHERE x = y OR (length(x) > 2 AND length(y) > 2 AND {_ratio("x", "y")} >= 0.7)),
    l AS MATERIALIZED (SELECT verse_id, k, list(j) AS js FROM m GROUP BY ALL), x AS MATERIALIZED (SELECT w.verse_id, kk AS k, coalesce(js, []) AS js FROM (SELECT verse_id, unnest(range(len(t))) AS kk FROM w) w LEFT JOIN l ON l.verse_id = w.verse_id AND l.k = kk),
    r AS (SELECT verse_id, 0::BIGINT AS k, 0::BIGINT AS nxt, NULL::BIGINT AS place FROM w UNION ALL
        SELECT verse_id, k + 1, coalesce(hit + 1, nxt), hit FROM (SELECT r.verse_id, r.k, r.nxt, list_min(list_filter(x.js, lambda j: j >= r.nxt AND j < r.nxt + 5)) AS hit FROM r JOIN x ON x.verse_id = r.verse_id AND x.k = r.k))
    SELECT verse_id, place::INT AS place FROM r WHERE place IS NOT NULL UNION ALL SELECT verse_id, NULL FROM r GROUP BY verse_id HAVING count(place) = 0"""
SQL["align_words"] = _ALIGN


@_put("window_score", _WINDOWS)
def _(s, d):
    return cq.QUERIES["window_match"](s, d).select("verse_id", "score")


@_put("runners_up_ascii", f"WITH {_C}, {_EVERY_Q}, {_FOUND}, {_PLAIN_PAIRS}, {_SCORED}, {_RANKED} SELECT qid, string_agg(book || ':' || surah || ':' || ayah, ' ' ORDER BY place) AS runners FROM ranked WHERE place <= 5 GROUP BY qid")
def _(s, d):
    c = cq._folded_corpus(s, d)
    prepared, same = mt.once(mt.prepare(_folded_text(cq._transcripts(s, d))))
    got = mt.runners_up(mt.score_candidates(prepared, cp.stored(c), mt.PRODUCT), c)
    return mt.given(got.select("qid", F.array_join(F.transform("runners", lambda r: F.concat_ws(":", r["book"], r["surah"], r["ayah"])), " ").alias("runners")), same)
