import numpy as np
import pytest
from pyspark.sql import functions as F

from scansio.operators import corpus as cp
from scansio.operators import hits as ht
from scansio.operators import matching as mt
from scansio.session import load


def best_of(asked, verses, k):
    """hits, first and number of the best verses, from the definition."""
    tri = lambda t: list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2)))
    out = []
    for at, v in enumerate(verses):
        common = [i for i, t in enumerate(tri(asked)) if t in v]
        if common:
            out.append((-len(common), common[0], at))
    return sorted(out)[:k]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_best_is_the_best_of_all(block):
    rng = np.random.default_rng(5)
    text = lambda least, most: "".join(rng.choice(list("abc\U00010400"), rng.integers(least, most)))
    verses, asked = [text(0, 12) for _ in range(200)], [text(3, 9) for _ in range(20)]
    best = ht.Best(asked, 6)
    for i in range(0, len(verses), block):
        best.meet(verses[i : i + block], np.arange(i, min(i + block, len(verses))))
    for q, keys, ats in zip(asked, best.keys, best.ats):
        assert [(int(k >> 32), int(k & 0xFFFFFFFF), int(a)) for k, a in zip(keys, ats)] == best_of(q, verses, 6)


def test_transcripts_in_several_parts(spark, sf, monkeypatch):
    corpus = cp.build(load(spark, sf, "verses"))
    asked = mt.prepare(load(spark, sf, "messages").where("msg_type = 'raw_transcript' AND msg_id % 20 = 0").select(F.col("msg_id").alias("qid"), "text"))
    rows = lambda: sorted(map(tuple, mt.candidates(asked, corpus, 20).collect()))
    whole = rows()
    monkeypatch.setattr(ht, "HELD", 5)
    assert whole and rows() == whole


def test_trigrams_are_not_joined(spark, sf):
    """A join on trigrams has a row for each pair of a transcript and a verse with a common one, and they were shuffled."""
    asked = mt.prepare(load(spark, sf, "messages").select(F.col("msg_id").alias("qid"), "text"))
    plan = mt.candidates(asked, cp.build(load(spark, sf, "verses")), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "(tri#" not in plan


@pytest.mark.parametrize("least", [1, 9])
def test_what_a_task_did_not_send_is_counted_again(spark, sf, monkeypatch, least):
    """A task sent all `k` best of each transcript, most of them for nothing."""
    corpus = cp.stored(cp.build(load(spark, sf, "verses")))
    asked = mt.prepare(load(spark, sf, "messages").where("msg_type = 'raw_transcript' AND msg_id % 20 = 0").select(F.col("msg_id").alias("qid"), "text"))
    rows = lambda: sorted(map(tuple, mt.candidates(asked, corpus, 20).collect()))
    monkeypatch.setattr(ht, "SENT", 1000)
    whole = rows()
    monkeypatch.setattr(ht, "SENT", 0)
    monkeypatch.setattr(ht, "SENT_LEAST", least)
    assert whole and rows() == whole
