"""Decoding against brute force, mel features, experiments and replays."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scansio.functions import mel
from scansio.operators import decoding as dc
from scansio.plans import experiments as ex
from scansio.streaming import replay as rp

PIECES, BLANK = {0: "▁a", 1: "b", 2: "▁c"}, 3


def frames(seed, n=5):
    p = np.random.default_rng(seed).dirichlet(np.ones(4), n)
    return np.log(p)


def collapsed(path):
    return tuple(t for t, before in zip(path, (None, *path)) if t != before and t != BLANK)


def all_sequences(f):
    out = defaultdict(float)
    for path in itertools.product(range(4), repeat=len(f)):
        out[collapsed(path)] += np.exp(sum(f[i][t] for i, t in enumerate(path)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_scores_are_sums_over_alignments(seed):
    f = frames(seed)
    for tokens, p in all_sequences(f).items():
        assert dc.forward_score_of(f, list(tokens), BLANK) == pytest.approx(np.log(p))
    assert dc.forward_score_of(f, [0] * 6, BLANK) == -np.inf and dc.forward_score_of([], [], BLANK) == 0


@pytest.mark.parametrize("seed", range(6))
def test_beams_find_the_best(seed):
    f = frames(seed)
    texts = defaultdict(float)
    for tokens, p in all_sequences(f).items():
        texts[dc._text(tokens, PIECES)] += p
    got = dc.beam_of(f, PIECES, BLANK, width=400, top=5)
    assert [np.exp(x) for _, x in got] == pytest.approx(sorted(texts.values(), reverse=True)[:5]) and len(dict(got)) == 5
    assert dc.beam_of([], PIECES, BLANK) == [("", 0.0)]


def test_greedy_joins_repeats():
    f = np.eye(4)[[0, 0, 3, 0, 1, 1, 2]]
    assert dc.greedy_of(f, PIECES, BLANK) == "a ab c" and dc.greedy_of([], PIECES, BLANK) == ""


def test_decoding_of_rows(spark):
    rows = [(1, frames(1).tolist(), [0, 1]), (2, None, [0]), (3, frames(2).tolist(), None), (4, [], [])]
    df = spark.createDataFrame(rows, "id long, f array<array<double>>, t array<int>")
    h = dc.hypotheses(df, "id", "f", PIECES, BLANK, top=3)
    assert {r.id: r.n for r in h.groupBy("id").agg(F.count("*").alias("n")).collect()} == {1: 3, 3: 3, 4: 1}
    got = {r.id: r.log_prob for r in dc.rescored(df, "f", "t", BLANK).collect()}
    assert got[1] == pytest.approx(dc.forward_score_of(frames(1), [0, 1], BLANK)) and got[2] is None and got[3] is None and got[4] == 0


def test_mel_features(spark):
    t = np.arange(16_000) / 16_000
    f = mel.features_of(np.sin(2 * np.pi * 1000 * t))
    assert f.shape == (98, 80) and mel.features_of(np.zeros(399)).shape == (0, 80)
    centres = mel.filters().argmax(axis=1) * 16_000 / 512
    assert abs(centres[f.mean(axis=0).argmax()] - 1000) < 100
    assert np.allclose(mel.features_of(np.zeros(400)), np.log(mel.FLOOR))
    df = spark.createDataFrame([(1, [0.0] * 560), (2, None), (3, [])], "id long, x array<float>").select("id", F.size(mel.features("x")).alias("n"))
    assert {r.id: r.n for r in df.collect()} == {1: 2, 2: None, 3: 0}


def test_experiments(spark):
    ex.register("fixed", lambda path: {"surah": 1, "ayah": int(path), "score": 0.5} if path != "0" else None, lambda: 7)
    assert "fixed" in ex.list_models() and ex.get("fixed").model_size() == 7
    df = spark.createDataFrame([("a", "3"), ("b", "0"), ("c", None)], "sample_id string, file string")
    assert [tuple(r) for r in ex.predictions(df, "fixed").collect()] == [("a", 1, 3, None, 0.5)]
    with pytest.raises(ValueError):
        ex.register("fixed", lambda path: None)


def test_replay_in_order(spark, tmp_path):
    recordings = spark.createDataFrame([(1, [float(i) for i in range(25)]), (2, [1.0] * 7), (3, [])], "session_id long, samples array<float>")
    chunks = rp.chunked(recordings, 10)
    assert [(r.session_id, r.seq, len(r.samples)) for r in chunks.orderBy("session_id", "seq").collect()] == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 7)]
    rp.written_for_replay(chunks.coalesce(1), str(tmp_path / "r"), per_file=1)
    q = rp.replayed(spark, str(tmp_path / "r"), chunks.schema).writeStream.format("memory").queryName("replay").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("replay").count() == 4 and len(q.recentProgress) >= 3
