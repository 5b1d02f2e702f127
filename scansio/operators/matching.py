"""Approximate retrieval of the verses, or runs of verses, that transcripts come from.

`match` answers a whole table of transcripts at once: trigram candidates, component scores, context bonuses, runs of
verses, threshold. `search` scans everything. `PassageIndex` holds one book in memory and answers one transcript at a
time by the same rules, for the stream operator; its size is checked.

Ties: candidates are ranked by hits, the place of the first of the transcript's trigrams that hits, and the verse. The
best single verse is the one of those within 0.001 of the greatest total that is nearest in length, then the first
candidate; further ranks follow total, difference in length and candidate rank. A run of verses wins only if it scores
more; of runs the first in the order of surah rank, start and length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scansio.functions import distance as ds
from scansio.functions import score as sc
from scansio.functions import text as tx
from scansio.operators import batches, hinted
from scansio.operators import corpus as cp
from scansio.operators.batches import Asked
from scansio.operators.hits import most_common
from scansio.session import cut, written

EPSILON = 0.001
#: Transcripts of a block of a full scan.
SEARCH_BLOCK = 512
#: Transcripts whose pairs meet one copy of the verses, and pairs that a task scores, about.
HELD, PAIRS_HELD = 1 << 18, 1 << 18


@dataclass(frozen=True)
class Profile:
    """candidates: how many a transcript has; groups: surahs of the best singles whose runs are tried; span: verses of
    the longest run; threshold: least score of an answer; partial: whether word-window and sliding scores count;
    span_smart: whether runs are scored by length-aware scores."""

    candidates: int = 200
    groups: int = 20
    span: int = 3
    threshold: float = 0.3
    partial: bool = True
    span_smart: bool = False


PRODUCT = Profile()
EVAL3 = Profile(candidates=300, span=3, threshold=0.2, partial=False, span_smart=True)
EVAL6 = Profile(candidates=300, span=6, threshold=0.2, partial=False, span_smart=True)


def prepare(queries: DataFrame) -> DataFrame:
    """`qid, q, qns, qwords` (and hints) of transcripts `qid, text`; those under three characters have no answer."""
    q = queries.withColumn("q", tx.normalize(F.col("text"))).withColumn("qns", tx.no_spaces(F.col("q")))
    return q.where(F.length("qns") >= 3).withColumn("qwords", tx.words(F.col("q")))


def once(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers rest on text and hint alone, and sessions say the same again and again: of `prepared` one transcript of each
    text and hint, and `qid, own` of all, where `own` is the one that stands for it."""
    keys = ["q", *[c for c in ("hint_surah", "hint_ayah") if c in prepared.columns]]
    every = written(prepared.select("qid", *keys).distinct())
    one = written(every.groupBy(*keys).agg(F.min("qid").alias("qid")))
    a, b = every.alias("a"), one.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    same = a.join(b, on).select("a.qid", F.col("b.qid").alias("own"))
    return one.withColumns({"qns": tx.no_spaces(F.col("q")), "qwords": tx.words(F.col("q"))}), same


def given(answers: DataFrame, same: DataFrame) -> DataFrame:
    """The answers of the transcripts of `once` (qid, ...), given to all that they stand for."""
    return same.join(answers.withColumnRenamed("qid", "own"), "own").select(answers.columns)


def candidates(prepared: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """`qid, book, idx, hits, rank` (from 1): verses by distinct common trigrams."""
    verses = cp.stored(corpus)
    return most_common(prepared, verses.select("at", "ns"), k).join(verses.select("at", "book", "idx"), "at").select("qid", "book", "idx", "hits", "rank")


def smart(qns: Column, vns: Column, frag: Column) -> Column:
    """Ratio; of a text under 0.7 of the verse's length the better of fragment and its blend with the ratio."""
    r = sc.ratio(qns, vns)
    return F.when(F.length(qns) / F.length(vns) < 0.7, F.greatest(frag, 0.6 * frag + 0.4 * r)).otherwise(r)


def reach(a: Column, b: Column) -> Column:
    """The most that the ratio can be, by the lengths alone."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 1.0).otherwise((n - F.abs(F.length(a) - F.length(b))) / n)


_partial_kind = T.StructType([T.StructField(n, T.DoubleType()) for n in ("frag", "frag_nb", "window", "window_nb", "sliding")])


def partials_of(q: str, qns: str, rows: list[tuple[list[str], str, str | None, str | None]], partial: bool) -> np.ndarray:
    """The scores that Spark has no function for, of one transcript and verses (words, ns, no_bsm, no_bsm_ns): of
    fragments (with and without the opening), word windows (the same) and sliding runs; 0 where they don't count."""
    out = np.zeros((len(rows), 5))
    n, t = q.count(" ") + 1, q.split(" ")
    for col, texts in ((0, [r[1] for r in rows]), (1, [r[3] for r in rows])):
        short = [i for i, v in enumerate(texts) if v and len(qns) < 0.7 * len(v)]
        out[short, col] = ds.fragments(qns, [texts[i] for i in short])
    if not partial or n < 2:
        return out
    wide = [i for i, r in enumerate(rows) if len(r[0]) >= 5]
    fewer = [i for i in wide if n < len(rows[i][0]) * 0.8]
    windowed = [(i, 2, rows[i][0]) for i in fewer] + [(i, 3, nb) for i in fewer if rows[i][2] and len(nb := rows[i][2].split(" ")) >= 3]
    place = {w: k for k, w in enumerate(dict.fromkeys(w for _, _, words in windowed for w in words))}
    similar = [np.where([bool(w) for w in place], ds.ratios(a, list(place)), float(not a)) if a else np.array([float(not w) for w in place]) for a in t]
    for i, col, words in windowed:
        if len(words) >= n:
            ids = [place[w] for w in words]
            sims = np.array([similar[k][ids[k : k + len(words) - n + 1]] for k in range(n)])
            out[i, col] = (0.6 * ((sims >= sc.WORD_MATCH).sum(axis=0) / n) + 0.4 * (sims.sum(axis=0) / n)).max()
    sliding = {i for i in wide if len(qns) < len(rows[i][1]) * 0.8}
    _windows_of(q, n, [(i, col, words, col == 2 and i in sliding) for i, col, words in windowed] + [(i, None, rows[i][0], True) for i in sliding.difference(fewer)], out)
    joined = []
    for i in wide:
        words = rows[i][0]
        if i in sliding:
            whole = "".join(words)
            if 5 <= len(qns) < len(whole) * 0.85:
                joined.append((i, whole))
    if joined:
        i = [i for i, _ in joined]
        out[i, 4] = np.maximum(out[i, 4], ds.fragments(qns, [x for _, x in joined]))
    return out


def _windows_of(q: str, n: int, asked: list[tuple[int, int | None, list[str], bool]], out: np.ndarray) -> None:
    """Raise `out` to the ratios of `q`, of `n` words, with runs of words of verses. Of `row, column, words, slides`: runs of
    one word less and one more count in the column; with `slides` those of one more, cut at the verse's end, in the last.
    Runs from one place are prefixes of one stretch, so each place is one pass."""
    flat, starts, lens, short, places = [], [], [], [], []
    base = 0
    for i, col, words, slides in asked:
        ends = np.cumsum([len(w) + 1 for w in words])  # each word with the space after it
        begins = np.concatenate([[0], ends[:-1]])
        s = np.arange(max(1, len(words) - n + (2 if col is not None else 1)))
        stop = np.minimum(s + n + 1, len(words))
        starts.append(base + begins[s])
        lens.append(ends[stop - 1] - 1 - begins[s])
        less = s + n - 1
        short.append(np.where((less >= 1) & (less <= len(words)) & (col is not None), ends[np.clip(less, 1, len(words)) - 1] - 1 - begins[s], 0))
        whole = np.where(s + n + 1 <= len(words), col if col is not None else -1, -1)
        slide = np.where(slides & (s <= max(0, len(words) - n)), 4, -1)
        places.append(np.stack([np.full(len(s), i), np.full(len(s), -1 if col is None else col), whole, slide]))
        flat.append(" ".join(words) + " ")
        base += int(ends[-1])
    if not flat:
        return
    start, size, less = (np.concatenate(x).astype(np.int64) for x in (starts, lens, short))
    row, col, whole, slide = np.concatenate(places, axis=1)
    full, _, part = ds.stretches(q, "".join(flat), start, size, asked=less)
    ratio = lambda d, length: (len(q) + length - d) / np.maximum(1, len(q) + length)
    for columns, scores in ((np.where(less > 0, col, -1), ratio(part, less)), (whole, ratio(full, size)), (slide, ratio(full, size))):
        there = columns >= 0
        np.maximum.at(out, (row[there], columns[there]), scores[there])


def _no_spaces(text: str) -> str:
    return text.replace(" ", "")


def _partials(partial: bool):
    @F.pandas_udf(_partial_kind)
    def run(q: pd.Series, norm: pd.Series, nb: pd.Series) -> pd.DataFrame:
        got = np.zeros((len(q), 5))
        q, norm, nb = q.to_numpy(), norm.to_numpy(), nb.to_numpy()
        fit = np.array([Asked.fits(x) for x in q], bool)
        if fit.any():
            got[fit] = batches.partials(q[fit].tolist(), norm[fit].tolist(), nb[fit].tolist(), partial)
        for x in dict.fromkeys(q[~fit]):
            i = np.flatnonzero(q == x)
            rows = [(v.split(" "), _no_spaces(v), w, w and _no_spaces(w)) for v, w in zip(norm[i], nb[i])]
            got[i] = partials_of(x, _no_spaces(x), rows, partial)
        return pd.DataFrame(got, columns=_partial_kind.names)

    return run


def score_pairs(pairs: DataFrame, prepared: DataFrame, partial: bool = True) -> DataFrame:
    """`pairs` of transcripts and verses (PAIR, and more) with `raw`, `total` and `diff`, the parts that need Python in one
    Arrow pass over pairs of a transcript that lie together, the rest native. A transcript has a bounded number of pairs;
    their number of partitions is given, as the sizes by which AQE merges them don't tell the work in Python. No more than
    one text with and without its opening goes through the shuffle: all others follow from these."""
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, parts_of(pairs))
    together = pairs.repartition(parts, "qid").join(prepared.select("qid", "q"), "qid")
    return _scored(together, pairs.columns, partial)


def score_found(found: DataFrame, verses: DataFrame, prepared: DataFrame, profile: Profile) -> DataFrame:
    """`score_pairs` of pairs `qid, at` (and more) where there are many of each transcript. They are scored where the verses
    are: with a pair goes the transcript, which is shorter and beside its others, and the text of a verse goes once for
    HELD transcripts or so, however many pairs it is in."""
    asked = prepared.count()
    held = max(1, -(-asked // HELD))
    per = -(-max(2 * found.sparkSession.sparkContext.defaultParallelism, -(-asked * profile.candidates // PAIRS_HELD)) // held)
    # Tasks are named: a join makes of other numbers of partitions its own, and pairs of a transcript are scored together.
    task = lambda slice_: (slice_ * per + F.pmod(F.xxhash64("at"), F.lit(per))).cast("int").alias("task")
    pairs = found.join(prepared.select("qid", "q"), "qid").select("*", task(F.pmod(F.xxhash64("qid"), F.lit(held))))
    texts = verses.select("at", *PAIR, F.explode(F.sequence(F.lit(0), F.lit(held - 1))).alias("slice")).select("at", *PAIR, task(F.col("slice")))
    met = pairs.repartitionById(held * per, F.col("task")).join(texts.repartitionById(held * per, F.col("task")), ["task", "at"])
    return _scored(met, [*[c for c in found.columns if c != "at"], *PAIR], profile.partial)


def _scored(together: DataFrame, columns: list[str], partial: bool) -> DataFrame:
    """`columns` but texts, with `raw`, `total` and `diff`, of pairs with the transcript `q`, those of a transcript in a row."""
    c = F.col
    ns, nb_ns, qns = tx.no_spaces(c("norm")), tx.no_spaces(c("no_bsm")), tx.no_spaces(c("q"))
    p = together.sortWithinPartitions("qid").withColumns({"ns": ns, "no_bsm_ns": nb_ns, "qns": qns}).withColumn("_p", _partials(partial)("q", "norm", "no_bsm"))
    each = [
        F.when(F.length("ns") > 0, smart(c("qns"), c("ns"), c("_p.frag"))),
        smart(c("qns"), c("no_bsm_ns"), c("_p.frag_nb")),
        sc.ratio(c("q"), c("norm")),
        sc.ratio(c("q"), c("no_bsm")),
        c("_p.window") * 0.95,
        c("_p.window_nb") * 0.95,
        c("_p.sliding") * 0.92,
        F.when(c("bonus") > 0, sc.suffix_prefix(tx.words(c("q")), tx.words(c("norm")))),
    ]
    scored = p.withColumn("raw", F.greatest(*each)).withColumn("total", F.least(c("raw") + c("bonus"), F.lit(1.0)))
    return scored.withColumn("diff", F.abs(F.length("ns") - F.length("qns"))).select(*[x for x in columns if x not in ("norm", "no_bsm")], "raw", "total", "diff")


#: Columns of verses that pairs need, beside `qid` and `bonus`.
PAIR = ("book", "idx", "surah", "ayah", "norm", "no_bsm")


def score_candidates(prepared: DataFrame, corpus: DataFrame, profile: Profile) -> DataFrame:
    """Scored and ranked verses of every transcript: `qid, book, idx, surah, ayah, raw, bonus, total, place` (from 1),
    the candidates and the verses that a hint (hint_surah, hint_ayah) makes likely. Of these there are some in every book:
    with hints, what can't be among the first `profile.groups` places is left out before it is a row."""
    verses = cp.stored(corpus)
    prepared = cut(prepared)  # it is read in several places, and comes from all messages
    if "hint_surah" not in prepared.columns:
        found = most_common(prepared, verses.select("at", "ns"), profile.candidates).select("qid", "at", "rank")
        return ranked(score_found(found.withColumn("bonus", F.lit(0.0)), verses, prepared, profile))
    # Candidates and their scores without a bonus are those of a text, whatever hints it has.
    texts, same = once(prepared.select("qid", "q"))
    same = written(same)
    found = written(most_common(texts, verses.select("at", "ns"), profile.candidates).select(F.col("qid").alias("own"), "at", "rank"))
    own = written(bonuses_of(found, same.join(prepared, "qid"), verses))
    plain = found.select(F.col("own").alias("qid"), "at", "rank", F.lit(0.0).alias("bonus"), F.col("at").alias("verse"))
    plain = _maybe_first(score_found(plain, verses, texts, profile), profile.groups, "rank").withColumnRenamed("qid", "own")
    # A verse with a bonus scores no less with it: what others it leaves behind stays behind.
    plain = plain.join(same, "own").drop("own").join(own.select("qid", F.col("at").alias("verse")), ["qid", "verse"], "left_anti").drop("verse")
    best = hinted.likely(prepared, verses, profile.groups, profile.partial)
    kept = _maybe_first(best, profile.groups, "at").select("qid", "at", "bonus")
    others = kept.join(own, ["qid", "at"], "left_anti").withColumn("rank", F.lit(1_000_000))
    joined = own.unionByName(others)
    return ranked(score_found(joined, verses, prepared, profile).unionByName(plain)).where(F.col("place") <= profile.groups)


def _maybe_first(scored: DataFrame, k: int, last: str) -> DataFrame:
    """Of `scored` (qid, total, diff, ...) what may be among the `k` first places of `ranked`, whatever others score: with 1 the
    greatest total is known, else all that is near it stays. `last` decides between equals."""
    of = Window.partitionBy("qid")
    most = F.max("total").over(of)
    near = F.col("total") > most - EPSILON
    first = F.row_number().over(of.orderBy(F.desc("total"), "diff", last)) <= k
    close = near & ((most < 1) | (F.row_number().over(of.orderBy(near.desc(), "diff", F.desc("total"), last)) <= k))
    return scored.withColumns({"first": first, "close": close}).where("first OR close").drop("first", "close")


def bonuses_of(found: DataFrame, asked: DataFrame, verses: DataFrame) -> DataFrame:
    """`qid, at, rank, bonus` of those candidates `own, at, rank` of the texts of transcripts (qid, own, hint_surah, hint_ayah) that
    the hint gives a bonus, as `corpus.continuation_bonuses`."""
    hints = asked.where("hint_surah IS NOT NULL AND hint_ayah IS NOT NULL").select("qid", "own", F.col("hint_surah").alias("hs"), F.col("hint_ayah").alias("ha"))
    nth = F.row_number().over(Window.partitionBy("book", "surah").orderBy("ayah")) - 1
    refs = verses.select("at", "book", "surah", "ayah", nth.alias("nth"))
    within, rolled = f"surah = hs AND ayah - ha BETWEEN 1 AND {len(cp.BONUSES)}", f"surah = hs + 1 AND nth < {len(cp.BONUSES)}"
    some = found.join(refs, "at").join(hints, "own").where(f"{within} OR {rolled}")
    return _with_bonus(some, verses, F.when(F.col("surah") == F.col("hs"), F.col("ayah") - F.col("ha") - 1).otherwise(F.col("nth"))).select("qid", "at", "rank", "bonus")


def _with_bonus(some: DataFrame, verses: DataFrame, step: Column) -> DataFrame:
    """`some` (book, surah, hs, ha) in the surah of a hint where the book has the verse after it, or in the next where it
    hasn't, with the bonus of a step."""
    has = verses.select("book", F.col("surah").alias("hs"), (F.col("ayah") - 1).alias("ha"), F.lit(True).alias("has")).distinct()
    met = some.join(has, ["book", "hs", "ha"], "left").where("(surah = hs) = (has IS NOT NULL)")
    return met.withColumn("bonus", F.element_at(F.array(*map(F.lit, cp.BONUSES)), step.cast("int") + 1))


def ranked(scored: DataFrame) -> DataFrame:
    of = Window.partitionBy("qid")
    near = (F.col("total") > F.max("total").over(of) - EPSILON).cast("int")
    order = of.orderBy(F.desc("near"), F.when(F.col("near") == 1, F.col("diff")), F.desc("total"), "diff", "rank", "book", "idx")
    placed = scored.withColumn("near", near).withColumn("place", F.row_number().over(order))
    return placed.withColumn("best", F.first("total").over(order)).select("qid", "book", "idx", "surah", "ayah", "raw", "bonus", "total", "place", "best")


# Surahs whose first verse is a few letters that are read one by one.
LETTER_SURAHS = (2, 3, 7, 10, 11, 12, 13, 14, 15, 19, 20, 26, 27, 28, 29, 30, 31, 32, 36, 38, 40, 41, 42, 43, 44, 45, 46, 50, 68)
#: Characters that a verse may have more than a short text; fewest verses of a book that are worth trying alone.
SHORT_REACH, SHORT_LEAST = 5, 20


def short_candidates(corpus: DataFrame) -> DataFrame:
    """`n, book, idx`: the verses to try for texts of `n` characters without spaces, fewer than a trigram has: those hardly
    longer, and first verses of letters; of a book that has fewer than SHORT_LEAST of them all verses. There are three
    lengths, so whatever the number of texts they join these three sets by their length."""
    of = corpus.select("book", "idx", "surah", "ayah", "ns", "no_bsm_ns", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    near = (F.length("ns") <= F.col("n") + SHORT_REACH) | ((F.col("ayah") == 1) & F.col("surah").isin(*LETTER_SURAHS)) | (F.length("no_bsm_ns") <= F.col("n") + SHORT_REACH)
    marked = of.withColumn("near", F.coalesce(near, F.lit(False)))
    enough = marked.groupBy("n", "book").agg((F.count_if("near") >= SHORT_LEAST).alias("enough"))
    return marked.join(enough, ["n", "book"]).where("near OR NOT enough").select("n", "book", "idx")


def runners_up(singles: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """`qid, runners`: the k best single verses of each transcript in order, as `score_candidates` ranks them, each with its
    scores to three digits, the beginnings of its texts and its surah's name."""
    about = corpus.select("book", "idx", tx.preview(F.col("norm")).alias("text"), tx.preview(F.coalesce("text_uthmani", F.lit("")), 80).alias("text_uthmani"), "surah_name", "surah_name_en")
    top = singles.where(F.col("place") <= k).join(about, ["book", "idx"])
    own = [tx.rounded(F.col(c), 3).alias(n) for c, n in (("total", "score"), ("raw", "raw_score"), ("bonus", "bonus"))]
    each = F.struct("place", "book", "surah", "ayah", *own, "text", "text_uthmani", "surah_name", "surah_name_en")
    return top.groupBy("qid").agg(F.array_sort(F.collect_list(each)).alias("runners"))


def runs_of(corpus: DataFrame, span: int) -> DataFrame:
    """`book, surah, start, n, ayah, ayah_end, run_norm` of 2 to `span` consecutive verses of a surah; the first without
    its opening."""
    w = Window.partitionBy("book", "surah").orderBy("idx")
    # The beginning is made after the shuffle: it is the verse's own text but for a few.
    v = corpus.select("book", "surah", "idx", "ayah", "norm", "no_bsm")
    ahead = v.select("*", *[F.lead(F.struct("norm", "ayah"), k).over(w).alias(f"v{k}") for k in range(1, span)])
    each = []
    for n in range(2, span + 1):
        text = F.concat_ws(" ", F.coalesce("no_bsm", "norm"), *[F.col(f"v{k}.norm") for k in range(1, n)])
        each.append(F.when(F.col(f"v{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.col(f"v{n - 1}.ayah").alias("ayah_end"), text.alias("run_norm"))))
    return ahead.select("book", "surah", F.col("idx").alias("start"), "ayah", F.explode(F.array_compact(F.array(*each))).alias("r")).select("book", "surah", "start", "ayah", "r.*")


def match(queries: DataFrame, corpus: DataFrame, profile: Profile = PRODUCT) -> DataFrame:
    """`qid, book, surah, ayah, ayah_end, score, raw, bonus` of the best verse or run of every transcript that reaches the
    threshold; `ayah_end` is null for a single verse. `queries` has qid, text and may have hint_surah, hint_ayah."""
    (prepared, same), corpus = once(prepare(queries)), cp.stored(corpus)
    # Scored once: of each transcript the few rows that both branches need are written.
    singles = cut(score_candidates(prepared, corpus, profile).where(F.col("place") <= profile.groups))
    best = singles.where("place = 1").select("qid", "book", "surah", "ayah", F.lit(None).cast("int").alias("ayah_end"), F.col("total").alias("score"), "raw", "bonus", F.lit(0).alias("kind"), F.struct(F.lit(0), F.lit(0), F.lit(0)).alias("o"))
    groups = singles.groupBy("qid", "book", "surah").agg(F.min("place").alias("g"), F.first("best").alias("best"))
    asked = groups.join(prepared.select("qid", "q", "qns"), "qid")
    if "hint_surah" in prepared.columns:
        # A bonus belongs to at most three first verses of a hint: they are an array of the transcript's book and surah.
        hints = prepared.where("hint_surah IS NOT NULL AND hint_ayah IS NOT NULL").select("qid", F.col("hint_surah").alias("hs"), F.col("hint_ayah").alias("ha"))
        near = groups.select("qid", "book", "surah").join(hints, "qid").where("surah = hs OR surah = hs + 1")
        own = corpus.select("book", "surah", "ayah", (F.row_number().over(Window.partitionBy("book", "surah").orderBy("ayah")) - 1).alias("nth"))
        there = near.join(own, ["book", "surah"]).where(f"surah = hs AND ayah - ha BETWEEN 1 AND {len(cp.BONUSES)} OR surah = hs + 1 AND nth < {len(cp.BONUSES)}")
        step = F.when(F.col("surah") == F.col("hs"), F.col("ayah") - F.col("ha") - 1).otherwise(F.col("nth"))
        likely = _with_bonus(there, corpus, step).groupBy("qid", "book", "surah").agg(F.map_from_entries(F.collect_list(F.struct("ayah", "bonus"))).alias("likely"))
        asked = asked.join(likely, ["qid", "book", "surah"], "left")
        bonus = F.coalesce(F.col("a.likely")[F.col("r.ayah")], F.lit(0.0))
    else:
        bonus = F.lit(0.0)
    # Their number of partitions is given: few bytes are much work.
    parts = 4 * max(corpus.sparkSession.sparkContext.defaultParallelism, parts_of(corpus))
    runs = runs_of(corpus, profile.span).withColumn("run_n", F.length("run_norm"))
    a, r = (x.repartition(parts, "book", "surah").alias(n) for x, n in ((asked, "a"), (runs, "r")))
    on = (F.col("a.book") == F.col("r.book")) & (F.col("a.surah") == F.col("r.surah"))
    if not profile.span_smart:
        # No text is more like another than their lengths allow; a run must score more than the best single verse.
        m, n = F.length("a.q"), F.col("r.run_n")
        on = on & (2 * F.least(m, n) / (m + n) + bonus > F.col("a.best"))
    pairs = a.join(r, on).select("a.qid", "a.book", "a.surah", "a.g", "a.best", "a.q", "a.qns", "r.start", "r.ayah", "r.n", "r.ayah_end", "r.run_norm", bonus.alias("bonus"))
    if profile.span_smart:
        pairs = pairs.withColumn("rns", tx.no_spaces(F.col("run_norm"))).withColumn("f", sc.fragment(F.col("qns"), F.col("rns")))
        # As above: with the fragment known, lengths tell most runs that can't score more than the best single verse.
        r, f = reach(F.col("qns"), F.col("rns")), F.col("f")
        most = F.greatest(F.when(F.length("qns") / F.length("rns") < 0.7, F.greatest(f, 0.6 * f + 0.4 * r)).otherwise(r), reach(F.col("q"), F.col("run_norm")))
        raw = F.greatest(smart(F.col("qns"), F.col("rns"), f), sc.ratio(F.col("q"), F.col("run_norm")))
        pairs = pairs.where(F.least(most + F.col("bonus"), F.lit(1.0)) > F.col("best")).withColumn("raw", raw)
    else:
        pairs = pairs.withColumn("raw", sc.ratio(F.col("q"), F.col("run_norm")))
    runs = pairs.select("qid", "book", "surah", "ayah", "ayah_end", F.least(F.col("raw") + F.col("bonus"), F.lit(1.0)).alias("score"), "raw", "bonus", F.lit(1).alias("kind"), F.struct("g", "start", "n").alias("o"))
    # Partial aggregation keeps one row a transcript and task: the greatest score, a single before a run, the first run.
    o = lambda d, names: d.withColumn("k", F.struct("score", (-F.col("kind")).alias("a"), *[(-F.col("o")[n]).alias(f"b{i}") for i, n in enumerate(names)])).drop("o")
    all_ = o(best, ("col1", "col2", "col3")).unionByName(o(runs, ("g", "start", "n")))
    top = all_.groupBy("qid").agg(F.max_by(F.struct("book", "surah", "ayah", "ayah_end", "score", "raw", "bonus"), "k").alias("m")).select("qid", "m.*")
    return given(top.where(F.col("score") >= profile.threshold), same)


def parts_of(df: DataFrame) -> int:
    """In how many parts a table meets a query set: as many as shuffles have partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def search(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """`qid, book, idx, score, place`: the k most similar verses of each transcript by ratio, of all verses.

    Every transcript of the stated set meets every verse: that is what a full scan means. They meet in blocks of at most
    about SEARCH_BLOCK transcripts, and the verses in as many parts as there are shuffle partitions, so that a block is
    the work of many tasks; each task passes on no more than its k best.
    """
    prepared = prepare(queries).select("qid", "q")
    blocks = max(1, -(-prepared.count() // SEARCH_BLOCK))
    parts = parts_of(corpus)
    asked = prepared.select("*", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    verses = corpus.select("book", "idx", "norm", F.pmod(F.xxhash64("book", "idx"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    scored = verses.join(asked, ["block", "part"]).select("qid", "book", "idx", sc.ratio(F.col("q"), F.col("norm")).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "book", "idx")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def match_near(queries: DataFrame, corpus: DataFrame, ahead: int = 5, behind: int = 2, threshold: float = 0.35, profile: Profile = PRODUCT) -> DataFrame:
    """`match` of transcripts with a hint (hint_surah, hint_ayah) among the hinted verse, the `ahead` next of its book and the
    `behind` ones before in its surah: answers that reach the threshold. Where scores are equal the hinted verse comes
    first, then those ahead, then those before, and of books the first."""
    corpus = cp.stored(corpus)
    prepared = queries.withColumn("q", tx.normalize(F.col("text"))).withColumn("qns", tx.no_spaces(F.col("q"))).where("q <> ''").withColumn("qwords", tx.words(F.col("q")))
    prepared = cut(prepared)  # it is read in several places, and hints come from all messages
    best = hinted.nearest(prepared, corpus, ahead, behind, profile.partial)
    # `at` tells the order of books.
    one = best.groupBy("qid").agg(F.min_by(F.struct("at", "bonus"), F.struct(-F.col("total"), "rank", "at")).alias("m")).select("qid", "m.*")
    scored = score_pairs(one.join(corpus.select("at", *PAIR), "at").drop("at"), prepared, profile.partial)
    answer = scored.select("qid", "book", "surah", "ayah", F.lit(None).cast("int").alias("ayah_end"), F.col("total").alias("score"), "raw", "bonus")
    return answer.where(F.col("score") >= threshold)


def match_narrow(queries: DataFrame, corpus: DataFrame, ahead: int = 5, behind: int = 2, threshold: float = 0.35, profile: Profile = PRODUCT) -> DataFrame:
    """`match_near`; a transcript without a hint, or without an answer there, is matched against everything."""
    corpus = cp.stored(corpus)
    answered = cut(match_near(queries, corpus, ahead, behind, threshold, profile))  # a row a transcript; both branches need it
    rest = match(queries.join(answered, "qid", "left_anti"), corpus, Profile(**{**profile.__dict__, "threshold": threshold}))
    return answered.unionByName(rest)
