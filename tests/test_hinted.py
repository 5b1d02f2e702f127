import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scansio.operators import batches, hinted
from scansio.operators import corpus as cp
from scansio.operators import matching as mt
from scansio.session import load


@pytest.fixture(scope="module")
def verses(spark, sf):
    """The verses of each book in twenty more."""
    v = cp.build(load(spark, sf, "verses"))
    return cp.stored(v.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("book", F.concat_ws("-", "book", "copy")))


@pytest.fixture(scope="module")
def prepared(spark, sf):
    q = load(spark, sf, "messages").where("msg_type = 'raw_transcript' AND msg_id % 30 = 0").select(F.col("msg_id").alias("qid"), "text")
    return mt.prepare(q.withColumns({"hint_surah": (F.col("qid") % 7 + 1).cast("int"), "hint_ayah": (F.col("qid") % 5).cast("int")})).cache()


def test_scores_of_pairs_together_are_those_of_each_transcript():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcde"), rng.integers(1, 8)))
    text = lambda low, high: " ".join(word() for _ in range(rng.integers(low, high)))
    asked, verses = [text(1, 7) for _ in range(30)], [text(1, 40) for _ in range(50)] + ["", "a"]
    bare = [v.partition(" ")[2] or None if i % 3 else None for i, v in enumerate(verses)]
    asked = [q for q in asked if batches.Asked.fits(q)]
    got = batches.partials([q for q in asked for _ in verses], verses * len(asked), bare * len(asked), True).reshape(len(asked), len(verses), 5)
    rows = [(v.split(" "), v.replace(" ", ""), b, b and b.replace(" ", "")) for v, b in zip(verses, bare)]
    for q, own in zip(asked, got):
        assert np.array_equal(own, mt.partials_of(q, q.replace(" ", ""), rows, True))


def test_likely_verses_are_few_and_the_best_are_among_them(prepared, verses):
    every = cp.continuation_bonuses(prepared, verses).join(verses.select("at", *mt.PAIR), ["book", "surah", "ayah"])
    scored = mt.ranked(mt.score_pairs(every.withColumn("rank", F.lit(1)).drop("at"), prepared)).where("place <= 3")
    found = mt.hinted.likely(prepared, verses, 3, True)
    got = {(r.qid, r.book, r.idx): r for r in found.join(verses, "at").select("qid", "book", "idx", "bonus", "total").collect()}
    for r in scored.collect():
        own = got[r.qid, r.book, r.idx]
        assert (own.bonus, own.total) == (r.bonus, r.total)
    assert len(got) < every.count()


def test_long_transcripts_are_scored_too(spark, verses):
    v = verses.where("length(norm) > 70 AND ayah > 1").orderBy("at").limit(1).collect()[0]
    q = mt.prepare(spark.createDataFrame([(1, v.norm, v.surah, v.ayah - 1)], "qid long, text string, hint_surah int, hint_ayah int"))
    best = mt.score_candidates(q, verses, mt.PRODUCT).where("place = 1").collect()[0]
    assert (best.surah, best.ayah, best.total) == (v.surah, v.ayah, 1.0)


def test_what_is_far_in_length_stays_until_as_many_are_nearer():
    best = hinted.Best(["abc"], 2, False)
    rows = pd.DataFrame({"at": [1, 2, 3, 4], "total": [1.0, 0.9998, 0.9996, 0.5], "diff": [9, 8, 7, 1], "rank": 0, "bonus": 0.22}).to_numpy(float)
    best._keep(0, rows)
    assert best.rows[0][:, 0].tolist() == [1, 2, 3]
