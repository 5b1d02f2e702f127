import json
import struct

import numpy as np
from pyspark.sql import functions as F

from scansio.functions import signal as sg
from scansio.sources import files, wav


def test_wav_round_trip(spark, tmp_path):
    x = np.array([0, 0.5, -0.5, 1, -1, 2, -2], np.float32)
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8000))
    odd = wav.encode(x)
    (tmp_path / "b.wav").write_bytes(odd[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + odd[12:])
    (tmp_path / "c.wav").write_bytes(b"RIFFxx")
    got = {r.path[-5:]: r for r in wav.read(spark, str(tmp_path)).collect()}
    for n in ("a.wav", "b.wav"):
        assert np.allclose(got[n].samples, np.clip(x, -1, 1), atol=1e-4)
    assert got["a.wav"].rate == 8000 and got["b.wav"].rate == 16000 and got["c.wav"].samples is None
    assert wav.decode(None) == (None, None, None) and len(wav.encode([])) == 44


def test_signal(spark):
    df = spark.createDataFrame([([0.0, 0.5, -1.0, 2.0],), ([],)], "s array<float>")
    s = F.col("s")
    a, b = df.select(sg.rms(s).alias("r"), sg.to_int16(s).alias("i"), sg.tail(s, 2).alias("t"), sg.resampled(s, 32_000).alias("h"), sg.joined([s, s], 2).alias("j"), sg.is_silence(s).alias("q")).collect()
    assert round(a.r, 4) == 1.1456 and a.i == [0, 16383, -32768, 32767] and a.t == [-1.0, 2.0] and a.h == [0.0, -1.0] and len(a.j) == 10 and not a.q
    assert b.r is None and b.h == [] and b.t == [] and b.j == [0.0, 0.0]


def test_json_sources(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps([{"surah": 1, "ayah": 1, "text_uthmani": "x"}]))
    assert files.verses(spark, str(tmp_path / "v.json")).first().text_clean is None
    (tmp_path / "m.json").write_text(json.dumps({"samples": [{"id": "a", "surah": 1, "ayah": 2, "expected_verses": [{"surah": 1, "ayah": 2}]}]}))
    assert files.samples(spark, str(tmp_path / "m.json")).first().expected_verses[0].ayah == 2
    (tmp_path / "vocab.json").write_text(json.dumps({"0": "a", "1024": "<blank>"}))
    assert {r.token: r.piece for r in files.vocabulary(spark, str(tmp_path / "vocab.json")).collect()} == {0: "a", 1024: "<blank>"}
    for name, text in (("p1", json.dumps({"page": 2, "lines": []})), ("p2", json.dumps({"page": 1, "lines": None}))):
        (tmp_path / f"page-{name}.json").write_text(text)
    assert [r.page for r in files.layouts(spark, str(tmp_path / "page-*.json")).orderBy("page").collect()] == [1, 2]


def test_reports(spark, tmp_path):
    for n, text in (("a", '{"id":"a","timestamp":"2024-01-01T00:00:00Z"}'), ("b", '{"id":"b","timestamp":"2024-02-01T00:00:00Z"}'), ("c", "{broken")):
        (tmp_path / n).mkdir()
        (tmp_path / n / "meta.json").write_text(text)
    (tmp_path / "a" / "audio.wav").write_bytes(wav.encode([0.1]))
    got = files.newest_first(files.metas(spark, str(tmp_path / "*/meta.json"))).collect()
    assert [r.id for r in got] == ["b", "a"]
    assert files.blob(spark, str(tmp_path), "zzz").count() == 0 and files.blob(spark, str(tmp_path), "../a").count() == 0
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.blob(spark, str(tmp_path), "a").collect()) == ["audio.wav", "meta.json"]
    rows = spark.createDataFrame([(1, 2, 5, None), (None, 2, 5, None), (1, 2, -1, None)], "surah int, ayah int, audioSizeBytes long, timestamp string")
    files.write_reports(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert files.ranges(spark, [(1, 1, 3), (2, 5, 4)]).count() == 3


def test_uploads(spark, monkeypatch):
    from scansio.streaming import uploads as up

    monkeypatch.setattr(up, "MOST_SAMPLES", 5)
    monkeypatch.setattr(up, "MOST_MESSAGES", 3)
    m = spark.createDataFrame([(1, i, "t", str(i)) for i in range(9)] + [(2, 0, "t", "x")], "session_id long, seq long, msg_type string, text string")
    chunks = spark.createDataFrame([(1, i, [float(i)] * 2) for i in range(9)] + [(1, 20, [9.0])], "session_id long, seq long, samples array<float>")
    fired = spark.createDataFrame([(1, 6, "a"), (1, 0, "b"), (2, 3, "c"), (3, 1, "d")], "session_id long, seq long, trigger string")
    got = {r.trigger: r for r in up.uploads(fired, m, chunks).collect()}
    assert [e.seq for e in got["a"].events] == [4, 5, 6] and got["a"].samples == [4.0, 5.0, 5.0, 6.0, 6.0]
    assert [e.seq for e in got["b"].events] == [0] and got["b"].samples == [0.0, 0.0]
    assert [e.text for e in got["c"].events] == ["x"] and got["c"].samples is None and got["d"].events is None


def test_posted_in_order(spark, tmp_path):
    from scansio.streaming import uploads as up

    rows = spark.createDataFrame([(1, 2, 0), (1, 1, 1), (1, 1, 0), (2, 5, 0)], "session_id long, seq long, n int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = up.posted(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.session_id, r.seq, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert [x for x in got if x[0] == 1] == [(1, 1, 0), (1, 1, 1), (1, 2, 0)] and len(got) == 4
