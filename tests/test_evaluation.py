"""Evaluation, lists and short texts on small tables."""

from pyspark.sql import functions as F

from scansio.operators import corpus as cp
from scansio.operators import evaluation as ev
from scansio.operators import matching as mt
from scansio.operators import sequence as sq

VERSES = "verse_id long, edition string, surah int, ayah int, text_uthmani string, text_clean string, surah_name string, surah_name_en string"
SAMPLES = "sample_id string, category string, source string, expected_verses array<struct<surah:int,ayah:int>>, file string"
ANSWERS = "qid string, surah int, ayah int, ayah_end int, score double, time_ms long"


def corpus(spark, texts, extra=()):
    rows = [(i, b, s, a, t, t, f"n{s}", "x") for i, (b, s, a, t) in enumerate(texts)]
    return cp.build(spark.createDataFrame([*rows, *extra], VERSES))


def test_equivalents_count_within_their_surah(spark):
    c = corpus(spark, [("b", 1, 1, "one two three"), ("b", 1, 5, "one two three"), ("b", 2, 1, "one two three"), ("b", 1, 7, "a long text that is hardly another one x"), ("b", 1, 8, "a long text that is hardly another one y"), ("b", 3, 1, None)])
    refs = {tuple(r) for r in cp.equivalent_refs(c).collect()}
    assert refs == {(1, 1, 1, 5), (1, 5, 1, 1)}
    samples = spark.createDataFrame([("q1", "short", "x", [(1, 1)], "f"), ("q2", "short", "x", [(1, 7)], "f"), ("q3", "long", "x", [(2, 1)], "f"), ("q4", "long", None, [(1, 1), (1, 2)], "f"), ("q5", None, "x", [], "f")], SAMPLES)
    answers = spark.createDataFrame([("q1", 1, 5, None, 0.9, 10), ("q2", 1, 8, None, 0.9, 20), ("q3", 1, 1, None, 0.9, None), ("q4", 1, 3, None, 0.5, 4)], ANSWERS)
    similar = ev.similar_refs(samples, answers, c)
    assert {(1, 7, 1, 8)} <= {tuple(r) for r in similar.collect()}
    both = cp.equivalent_refs(c).unionByName(similar)
    got = {r.qid: r["class"] for r in ev.classify(samples, answers, both).collect()}
    assert got == {"q1": "equivalent", "q2": "equivalent", "q3": "wrong", "q4": "within2"}
    five = {r.qid: r["class"] for r in ev.classify_five(samples, answers, both).collect()}
    assert five == {"q1": "equiv", "q2": "equiv", "q3": "wrong", "q4": "adjacent"}
    assert {r.category: r.avg_ms for r in ev.accuracy(ev.classify(samples, answers, both), "category").collect()} == {"short": 15.0, "long": 4.0, None: 34 / 3}
    assert ev.classify_five(samples.limit(0), answers, both).count() == 0 == cp.equivalent_refs(c.limit(0)).count()


def test_clips_in_the_order_that_is_expected(spark):
    expected = spark.createDataFrame([("s", 0, 1, 3), ("s", 1, 1, 1), ("s", 2, 9, 9), ("s", 3, 1, 3)], "scenario string, pos int, surah int, ayah int")
    clips = spark.createDataFrame([(1, 1, "b"), (1, 3, "z"), (1, 3, "c"), (None, 1, "d")], "surah int, ayah int, file string")
    assert [tuple(r) for r in ev.clips_for(expected, clips).orderBy("place").collect()] == [("s", 0, 1, 3, "c"), ("s", 1, 1, 1, "b"), ("s", 2, 1, 3, "c")]


def test_short_texts_try_short_verses_or_all(spark):
    many = corpus(spark, [("b", 5, a, "abcd" if a <= 25 else "a long verse of many letters") for a in range(1, 41)] + [("c", 2, 1, "a long verse of many letters"), ("c", 2, 2, "another long verse of letters")])
    got = mt.short_candidates(many).groupBy("n", "book").agg(F.count("*").alias("k")).collect()
    assert {(r.n, r.book): r.k for r in got} == {(n, b): k for n in (0, 1, 2) for b, k in (("b", 25), ("c", 2))}


def test_runners_up_are_ranked(spark):
    c = corpus(spark, [("b", 1, a, t) for a, t in enumerate(["alpha bravo charlie", "alpha bravo delta", "alpha echo foxtrot", "golf hotel india"], 1)])
    q = spark.createDataFrame([(1, "alpha bravo charlie"), (2, "x"), (3, None)], "qid long, text string")
    got = mt.runners_up(mt.score_candidates(mt.prepare(q), c, mt.PRODUCT), c).collect()
    assert [r.qid for r in got] == [1] and [x.ayah for x in got[0].runners][:2] == [1, 2] and got[0].runners[0].score == 1.0
    assert got[0].runners[0].surah_name == "n1" and got[0].runners[0].text == "alpha bravo charlie"


def test_first_on_a_page_and_surahs_in_order(spark):
    m = spark.createDataFrame([(1, i, "verse_match", 1, a) for i, a in enumerate((1, 2, 5, 1))], "session_id long, seq long, msg_type string, surah int, ayah int")
    pages = spark.createDataFrame([("e", 1, 1, 1), ("e", 1, 2, 1), ("e", 1, 5, 2)], "edition string, surah int, ayah int, page int")
    assert [r.first for r in sq.first_on_page(m, pages).orderBy("seq").collect()] == [True, False, True, True]
    c = corpus(spark, [("b", 3, 1, "x"), ("b", 1, 1, "y"), ("b", 1, 2, "z")])
    assert [(r.surah, r.place) for r in cp.surah_list(c).orderBy("place").collect()] == [(1, 0), (3, 1)]


def test_missing_words_right_after_a_change_say_nothing(spark):
    rows = spark.createDataFrame([([0, 1, 4, 5], 500), ([0, 1, 4, 5], 2500), ([0, 1, 4, 5], None), ([0, 1], 9000)], "i array<int>, ms long")
    got = rows.select(sq.skipped(F.col("i"), sq.contiguous_prefix(F.col("i")), since_ms=F.col("ms")).alias("s")).collect()
    assert [r.s for r in got] == [None, [2, 3], [2, 3], None]
