import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scansio.operators import corpus as cp
from scansio.operators.passages import PassageIndex
from scansio.session import load
from scansio.streaming import tracker as tk


@pytest.fixture(scope="module")
def index(spark, sf):
    return PassageIndex.of(cp.build(load(spark, sf, "verses")), "ed00000")


def sound(n=tk.SEEK_CYCLE, level=0.1):
    return np.full(n, level, np.float32)


def steps(index, chunks):
    t, s = tk.Tracker(index, tk.last_text), tk.State()
    return [t.step(s, *c) for c in chunks], s


def test_a_verse_is_found_and_followed(index):
    v = next(v for v in index.verses if 6 <= len(v.words) <= 9 and v.no_bsm is None)
    found, s = steps(index, [(sound(), v.norm)])
    assert [m["type"] for m in found[0]][-1] == "verse_match" and s.verse == (v.surah, v.ayah)
    more = [(sound(tk.FOLLOW_CYCLE), v.norm)] * 3
    out, s = steps(index, [(sound(), v.norm), *more])
    kinds = [m["type"] for m in out[3]]
    assert out[1] == out[2] == [] and kinds[0] == "word_progress"  # two cycles of grace
    assert out[3][0]["word_index"] == out[3][0]["matched_indices"][-1] + 1
    assert kinds[1:] == ["verse_match"] and out[3][1]["confidence"] == 0.99 and len(s.sound) == 0


def test_nothing_before_a_cycle_nor_in_silence(index):
    out, _ = steps(index, [(sound(tk.SEEK_CYCLE - 1), "x")])
    assert out == [[]]
    out, s = steps(index, [(sound(level=0.001), index.verses[3].norm)])
    assert out == [[]] and s.heard == ""


def test_silence_ends_following(index):
    v = index.verses[5]
    out, s = steps(index, [(sound(), v.norm), (sound(level=0.0), "")])
    assert out[0] and s.verse is None and out[1] == []


def test_a_stale_match_is_taken_back(index):
    v = next(v for v in index.verses if 5 <= len(v.words) <= 9)
    chunks = [(sound(), v.norm)] + [(sound(tk.FOLLOW_CYCLE), "zzz")] * (2 + tk.STALE_LIMIT)
    _, s = steps(index, chunks)
    assert s.verse is None and s.last is None


def test_text_joins_where_it_overlaps():
    assert tk.joined_text("", "a b", 1) == ("a b", 1)
    assert tk.joined_text("xx yy zz", "yy zz ww", 2) == ("xx yy zz ww", 2)
    assert tk.joined_text("aaaaaa bbbbbb", "cd ef", 5) == ("cd ef", 1)


def test_state_survives_its_text(index):
    _, s = steps(index, [(sound(), index.verses[7].norm)])
    t = tk.State.load(s.dump())
    assert t.dump() == s.dump() and t.verse == s.verse


def test_stream_agrees_with_batch(spark, sf, index, tmp_path):
    m = load(spark, sf, "messages").where("msg_type = 'raw_transcript'").select("session_id", "seq", F.lit(tk.SEEK_CYCLE).alias("n_samples"), F.lit(0.1).alias("level"), "text").dropDuplicates(["session_id", "seq"])
    names = ["session_id", "seq", "n", "type", "surah", "ayah", "confidence", "word_index", "matched_indices", "text"]
    want = sorted(map(str, tk.track(m, index).select(*names).collect()))
    src = str(tmp_path / "src")
    for part in ("seq < 20", "seq >= 20"):
        m.where(part).coalesce(1).write.mode("append").parquet(src)
    files = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = tk.track_stream(files, index).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(str, spark.table("tracked").select(*names).collect()))
    assert want and len(got) == len(want) and got == want


CHUNK = "session_id long, seq long, n_samples int, level double, text string, reset boolean"


def test_a_reset_begins_anew(spark, index):
    v = next(v for v in index.verses if 6 <= len(v.words) <= 9 and v.no_bsm is None)
    said = lambda seq, n, reset=None: (1, seq, n, 0.1, v.norm, reset)
    follow = [said(i, tk.FOLLOW_CYCLE) for i in (1, 2, 3)]
    plain = [said(0, tk.SEEK_CYCLE), *follow]
    kinds = lambda rows: [(r.seq, r.type) for r in tk.track(spark.createDataFrame(rows, CHUNK), index).orderBy("seq", "n").collect()]
    assert (3, "word_progress") in kinds(plain) and kinds(plain)[0][0] == 0
    again = [*plain[:2], said(2, 0, True), said(3, tk.SEEK_CYCLE)]
    got = kinds(again)
    assert (3, "verse_match") in got and (3, "word_progress") not in got
    s = tk.State(seq=4, word=3, heard="x", verse=(1, 1))
    s.forget()
    assert s.dump() == tk.State(seq=4).dump()


def test_a_session_that_ends_leaves_no_state(spark, index, tmp_path):
    v = next(v for v in index.verses if 6 <= len(v.words) <= 9 and v.no_bsm is None)
    src = str(tmp_path / "src")
    write = lambda session, seq: spark.createDataFrame([(session, seq, tk.SEEK_CYCLE, 0.1, v.norm, None)], CHUNK).coalesce(1).write.mode("append").parquet(src)
    for session in (1, 2, 3):
        write(session, 0)
    files = spark.readStream.schema(CHUNK).parquet(src)
    q = tk.track_stream(files, index, idle_ms=1).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    try:
        left, until = [], time.time() + 90
        while (not left or left[-1] or max(left) < 3) and time.time() < until:
            time.sleep(0.5)
            left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    assert {r.session_id for r in spark.table("idle").collect()} == {1, 2, 3} and max(left) == 3 and left[-1] == 0
