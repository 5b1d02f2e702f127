from pyspark.sql import functions as F

from scansio.operators import decoding as dc
from scansio.operators import evaluation as ev
from scansio.operators import neighbours as nb
from scansio.operators import sequence as sq

MESSAGE = "msg_id long, session_id long, seq long, msg_type string, surah int, ayah int, word_index int, total_words int, matched_indices array<int>, confidence double, text string, ts timestamp"


def stream(spark, *rows):
    """Rows (seq, type, surah, ayah, second)."""
    made = [(i, 1, r[0], r[1], r[2], r[3], r[5] if len(r) > 5 else None, 4, r[6] if len(r) > 6 else None, 0.5, None) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(*m, r[4]) for m, r in zip(made, rows)], MESSAGE.replace("ts timestamp", "t double"))
    return sq.messages(df.withColumn("ts", F.timestamp_seconds("t")))


def test_oscillation_and_repeats(spark):
    m = stream(spark, (0, "verse_match", 1, 1, 0.0), (1, "verse_match", 1, 2, 1.0), (1, "verse_match", 9, 9, 1.0), (2, "verse_match", 1, 1, 2.0), (3, "verse_match", 1, 2, 3.0))
    assert {(r.from_ref, r.to_ref): r.n for r in sq.oscillation(m).collect()} == {("1:1", "1:2"): 1, ("1:2", "1:1"): 1}
    assert sq.settles(m).first().settled is False
    assert sq.latency(m).first().first_match == 0


def test_triggers_and_cooldown(spark):
    m = stream(spark, (0, "verse_match", 1, 1, 0.0), (1, "verse_match", 2, 1, 1.0), (2, "verse_match", 2, 2, 2.0), (3, "verse_match", 2, 3, 12.0), (4, "verse_match", 3, 1, 30.9), (5, "verse_match", 4, 1, 31.0))
    t = sq.triggers(m)
    assert [(r.seq, r.trigger) for r in t.orderBy("seq").collect()] == [(1, "surah_jump"), (2, "rapid_switching"), (4, "surah_jump"), (5, "surah_jump")]
    assert [r.seq for r in sq.cooled_down(t).orderBy("seq").collect()] == [1, 5]


def test_prefix_and_gap(spark):
    rows = [([], -1, None), ([1, 2], -1, None), ([0, 1, 1, 2], 2, None), ([0, 1, 4, 5], 1, [2, 3]), ([0, 4, 5], 0, None), ([0, 1, 4], 1, None), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "i array<int>").withColumn("p", sq.contiguous_prefix(F.col("i")))
    got = df.select("p", sq.skipped(F.col("i"), F.col("p")).alias("s")).collect()
    assert [(r.p, r.s) for r in got] == [(p, s) for _, p, s in rows]


def test_evaluation(spark):
    samples = spark.createDataFrame([("a", "short", "u", [(1, 1)]), ("b", "short", "u", [(1, 5), (1, 6)]), ("c", "long", "v", [(2, 1)]), ("d", "long", "v", [(3, 1)])], "sample_id string, category string, source string, expected_verses array<struct<surah:int,ayah:int>>")
    p = spark.createDataFrame([("a", 1, 1, None, 0.9), ("b", 1, 4, 6, 0.9), ("c", 2, 2, None, 0.9)], "qid string, surah int, ayah int, ayah_end int, score double")
    c = ev.classify(samples, p)
    assert {r.qid: r["class"] for r in c.collect()} == {"a": "exact", "b": "exact", "c": "within1", "d": "no_match"}
    eq = spark.createDataFrame([(2, 1, 2, 2)], "surah int, ayah int, other_surah int, other_ayah int")
    assert {r.qid: r["class"] for r in ev.classify(samples, p, eq).collect()}["c"] == "equivalent"
    a = {r.category: r for r in ev.accuracy(c, "category").collect()}
    assert a[None].n == 4 and a["short"].exact == 1.0 and a["long"].lenient == 0.5
    assert {r.qid: (r.n, r.covered) for r in ev.span_coverage(samples, p).collect()}["b"] == (2, 2)
    b = spark.createDataFrame([("a", 9, 9, None, 0.99), ("c", 2, 1, None, 0.97), ("e", 1, 1, None, 0.5)], "qid string, surah int, ayah int, ayah_end int, score double")
    low = p.withColumn("score", F.when(F.col("qid") == "c", 0.5).otherwise(0.9))
    assert {r.qid: r.surah for r in ev.better_of(low, b).collect()} == {"a": 1, "b": 1, "c": 2, "e": 1}
    clips = spark.createDataFrame([("full", "f", 1, 1), ("mid50", "m", 1, 1), ("mid50", "n", 1, 2)], "type string, file string, surah int, ayah int")
    assert {r.file: r.full_file for r in ev.full_clip(clips).collect()} == {"m": "f", "n": None}
    assert ev.sampled(clips, "file", 2, 1).collect() == ev.sampled(clips, "file", 2, 1).collect()


def test_neighbours_and_decoding(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "id long, e array<float>")
    assert [(r.query, r.id, r.place) for r in nb.nearest(v.where("id = 0"), v, "id", "e", 2).orderBy("place").collect()] == [(0, 1, 1), (0, 2, 2)]
    frames = [[0.9, 0.0, 0.1], [0.9, 0.0, 0.1], [0.0, 0.0, 1.0], [0.9, 0.0, 0.1], [0.0, 1.0, 0.0]]
    assert dc.greedy_of(frames, {0: "▁a", 1: "b"}, 2) == "a ab"
    df = spark.createDataFrame([(frames,), (None,)], "f array<array<double>>")
    assert [r[0] for r in df.select(dc.greedy(F.col("f"), {0: "▁a", 1: "b"}, 2)).collect()] == ["a ab", None]
    h = spark.createDataFrame([(1, 0, "x", 0.5), (1, 1, "y", 0.5), (1, 2, "z", 0.4)], "qid int, hyp int, ref string, score double")
    assert dc.best_hypothesis(h).first().ref == "x"
    assert {r.ref for r in dc.gated(h, lambda d: d.where("hyp = 2"), 0.5).collect()} == {"x", "y", "z"}


def test_stretches_of_a_session_hang_together(spark, monkeypatch):
    import random

    monkeypatch.setattr(sq, "STRETCH", 3)
    rng = random.Random(4)
    rows = [(s, q, rng.randint(0, 2)) for s in (1, 2, 3) for q in rng.sample(range(60), 3 if s == 3 else 25)]
    df = spark.createDataFrame(rows, "session_id long, seq long, v int").repartition(3)
    got = {(r.session_id, r.seq): (r.sum, r.one, r.two) for r in sq.running(sq.back(df, "v", "one", "two"), F.col("v"), "sum").collect()}
    want = {}
    for s in (1, 2, 3):
        own = sorted((q, v) for t, q, v in rows if t == s)
        for i, (q, _) in enumerate(own):
            want[s, q] = (sum(v for _, v in own[: i + 1]), own[i - 1][1] if i > 0 else None, own[i - 2][1] if i > 1 else None)
    assert got == want
    assert sq.running(sq.back(df.limit(0), "v", "one"), F.col("v"), "sum").count() == 0
