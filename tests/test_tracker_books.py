from pyspark.sql import functions as F

from scansio.operators import corpus as cp
from scansio.operators.passages import PassageIndex
from scansio.session import load
from scansio.streaming import tracker as tk

VERSES = "verse_id long, edition string, surah int, ayah int, text_uthmani string, text_clean string, surah_name string, surah_name_en string"
TEXTS = {"a": ["alpha bravo charlie delta echo", "foxtrot golf hotel india juliet"], "b": ["kilo lima mike november oscar", "papa quebec romeo sierra tango"]}


def test_a_reading_of_any_book_is_matched(spark):
    verses = [(i, b, 1, a, t, t, "x", "x") for i, (b, a, t) in enumerate((b, a, t) for b, ts in TEXTS.items() for a, t in enumerate(ts, 1))]
    corpus = cp.build(spark.createDataFrame(verses, VERSES))
    rows = [(1, 0, TEXTS["a"][1]), (2, 0, TEXTS["b"][1]), (3, 0, TEXTS["b"][0]), (None, 0, "x"), (4, None, "x")]
    chunks = spark.createDataFrame(rows, "session_id long, seq long, text string").select("*", F.lit(tk.SEEK_CYCLE).alias("n_samples"), F.lit(0.1).alias("level"))
    got = tk.track_books(chunks, corpus).where("type = 'verse_match' AND confidence = 1").collect()
    assert sorted((r.session_id, r.seq, r.book, r.ayah) for r in got) == [(1, 0, "a", 2), (2, 0, "b", 2), (3, 0, "b", 1)]


def test_every_book_is_followed_as_it_is_alone(spark, sf):
    corpus = cp.build(load(spark, sf, "verses"))
    books = [r[0] for r in corpus.select("book").distinct().collect()]
    chunks = load(spark, sf, "messages").where("msg_type = 'raw_transcript'").select("session_id", "seq", F.lit(tk.SEEK_CYCLE).alias("n_samples"), F.lit(0.1).alias("level"), "text").dropDuplicates(["session_id", "seq"])
    cols = ["session_id", "seq", "n", "type", "surah", "ayah", "confidence", "word_index", "matched_indices"]
    want = sorted(str((b, *r)) for b in books for r in tk.track(chunks, PassageIndex.of(corpus, b)).select(*cols).collect())
    got = sorted(str(tuple(r)) for r in tk.track_books(chunks, corpus).select("book", *cols).collect())
    assert want and got == want


def test_query_has_every_book(spark, sf):
    from scansio.plans import core_queries as cq

    assert {r.book for r in cq.QUERIES["stream_tracker"](spark, sf).select("book").distinct().collect()} == {r.edition for r in load(spark, sf, "verses").where("edition IS NOT NULL").select("edition").distinct().collect()}
