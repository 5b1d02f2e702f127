"""Queries that answered every hundredth transcript answer all, one of each text standing for its equals."""

import pytest
from pyspark.sql import functions as F

from scansio.functions.pytext import normalized
from scansio.operators import corpus as cp
from scansio.operators import matching as mt
from scansio.plans import registry
from scansio.session import load


@pytest.fixture(scope="module")
def texts(spark, sf):
    """Every transcript's text that has an answer at all: it shares three letters with some verse."""
    q = load(spark, sf, "messages").where("msg_type = 'raw_transcript'").select(F.col("msg_id").alias("qid"), "text")
    found = mt.candidates(mt.prepare(q), cp.build(load(spark, sf, "verses")), 1).select("qid")
    return {r.qid: normalized(r.text) for r in q.join(found, "qid").collect()}


@pytest.mark.parametrize("name", ["match_eval", "match_single", "match_span", "runners_up_ascii"])
def test_every_transcript_is_answered(spark, sf, texts, name):
    got = {}
    for r in registry.queries()[name](spark, sf).collect():
        got.setdefault(r.qid, []).append(tuple(r)[1:])
    least = 0.98 if name.startswith("match_") and name != "match_single" else 1  # an answer must reach a score
    assert set(got) <= set(texts) and len(got) >= least * len(texts)
    by_text = {}
    for q, rows in got.items():
        assert by_text.setdefault(texts[q], sorted(rows, key=str)) == sorted(rows, key=str)


def test_equal_texts_are_scored_once(spark, sf):
    q = spark.createDataFrame([(5, "ab cd", 1, 2), (3, "ab  cd ", 1, 2), (4, "ab cd", None, None), (9, "ab cd", None, None), (7, "abcd", 1, 2), (1, "ab", 1, 2)], "qid long, text string, hint_surah int, hint_ayah int")
    one, same = mt.once(mt.prepare(q))
    assert sorted((r.qid, r.q, r.qns, r.hint_surah) for r in one.collect()) == [(3, "ab cd", "abcd", 1), (4, "ab cd", "abcd", None), (7, "abcd", "abcd", 1)]
    assert sorted(map(tuple, same.collect())) == [(3, 3), (4, 4), (5, 3), (7, 7), (9, 4)]
    assert sorted(map(tuple, mt.given(one.select("qid", "hint_surah"), same).collect())) == [(3, 1), (4, None), (5, 1), (7, 1), (9, None)]


def test_every_transcript_is_answered_with_its_hint(spark, sf, texts):
    got = [r.qid for r in registry.queries()["match_hinted"](spark, sf).collect()]
    assert len(set(got)) == len(got) >= 0.97 * len(texts)  # redelivered ones aside


def test_texts_with_several_hints(spark, sf):
    """Candidates are scored once a text; what a bonus moves is ranked as if each transcript had been scored with all."""
    v = cp.build(load(spark, sf, "verses")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(3))))
    verses = cp.stored(v.withColumn("book", F.concat_ws("-", "book", "copy")))
    q = load(spark, sf, "messages").where("msg_type = 'raw_transcript' AND msg_id % 60 = 0").select("msg_id", "text")
    near = verses.where("ayah BETWEEN 2 AND 4 AND surah <= 2 AND book LIKE '%-0'").select((F.col("at") % 100_000 + 1_000_000).alias("msg_id"), F.substring("norm", 1, 24).alias("text"))
    hint = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("s"), F.lit(a).cast("int").alias("a")) for s, a in ((1, 1), (1, 2), (2, 1), (2, 2), (1, 900), (None, None))]))
    asked = q.unionByName(near).select("text", hint.alias("h"), "msg_id").select(F.pmod(F.xxhash64("msg_id", "h"), F.lit(1 << 40)).alias("qid"), "text", F.col("h.s").alias("hint_surah"), F.col("h.a").alias("hint_ayah"))
    prepared, profile = mt.prepare(asked).cache(), mt.Profile(candidates=40, groups=3)
    bonus = cp.continuation_bonuses(prepared, verses).join(verses.select("book", "surah", "ayah", "idx"), ["book", "surah", "ayah"]).select("qid", "book", "idx", "bonus")
    every = mt.candidates(prepared, verses, 40).drop("hits").join(bonus, ["qid", "book", "idx"], "full")
    every = every.withColumns({"rank": F.coalesce("rank", F.lit(1_000_000)), "bonus": F.coalesce("bonus", F.lit(0.0))}).join(verses.select(*mt.PAIR), ["book", "idx"])
    want = mt.ranked(mt.score_pairs(every, prepared)).where("place <= 3")
    got = mt.score_candidates(prepared, verses, profile)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert got.where("bonus > 0").count() and got.where("bonus = 0").count()
