import pytest
from pyspark.sql import functions as F

from scansio.functions.pytext import normalized
from scansio.operators import corpus as cp
from scansio.operators import matching as mt
from scansio.operators.passages import PassageIndex
from scansio.session import load


@pytest.fixture(scope="module")
def book(spark, sf):
    c = cp.build(load(spark, sf, "verses")).where("book = 'ed00000'").cache()
    return c, PassageIndex.of(c, "ed00000")


@pytest.fixture(scope="module")
def asked(spark, sf):
    return load(spark, sf, "messages").where("msg_type = 'raw_transcript' AND msg_id % 20 = 0").select(F.col("msg_id").alias("qid"), "text").cache()


def same(got, want):
    if want is None:
        return got is None
    return got is not None and (got.surah, got.ayah, got.ayah_end) == (want.surah, want.ayah, want.ayah_end) and abs(got.score - want.score) < 1e-9


@pytest.mark.parametrize("hint", [None, (2, 3), (1, 7), (40, 99)])
def test_batch_agrees_with_the_index(book, asked, hint):
    corpus, index = book
    q = asked if hint is None else asked.withColumns({"hint_surah": F.lit(hint[0]), "hint_ayah": F.lit(hint[1])})
    got = {r.qid: r for r in mt.match(q, corpus).collect()}
    for r in asked.collect():
        assert same(got.get(r.qid), index.match(normalized(r.text), hint=hint))


def test_narrow_agrees_with_the_index(book, asked):
    corpus, index = book
    q = asked.withColumns({"hint_surah": F.lit(2), "hint_ayah": F.lit(3)})
    got = {r.qid: r for r in mt.match_narrow(q, corpus).collect()}
    for r in asked.collect():
        assert same(got.get(r.qid), index.narrow(normalized(r.text), (2, 3)))


def test_no_answer_for_nothing(spark, book):
    corpus, _ = book
    q = spark.createDataFrame([(1, ""), (2, None), (3, "  "), (4, "اب"), (5, "zzzzzzzz")], "qid long, text string")
    assert mt.match(q, corpus).count() == 0
    assert mt.match(q.limit(0), corpus).count() == 0
    assert mt.match(q, corpus.limit(0)).count() == 0


def test_whole_verses_find_themselves(book):
    corpus, index = book
    for v in index.verses[:40]:
        if len(v.ns) >= 12:
            a = index.match(v.norm)
            assert a.score == pytest.approx(1.0)


def test_next_of_rolls_over(book):
    _, index = book
    last = {v.surah: v.ayah for v in index.verses}
    assert index.verses[index.next_of(1, last[1])].surah == 2
    assert index.next_of(max(last), last[max(last)]) is None


def test_index_is_bounded(monkeypatch, book):
    import scansio.operators.passages as ps

    monkeypatch.setattr(ps, "MOST_VERSES", 3)
    with pytest.raises(ValueError):
        ps.PassageIndex(book[1].verses)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_of_a_verse_goes_with_each_pair(spark, sf, asked):
    """Pairs were shuffled by transcript with the texts of their verses: the most of all that was written."""
    verses = cp.stored(cp.build(load(spark, sf, "verses")))
    got = mt.score_candidates(mt.prepare(asked), verses, mt.PRODUCT)
    assert "RepartitionByExpression [qid#" not in plan_of(got)


@pytest.mark.parametrize("held", [2, 50])
def test_transcripts_in_several_slices(spark, sf, asked, monkeypatch, held):
    verses = cp.stored(cp.build(load(spark, sf, "verses")))
    rows = lambda: sorted(map(tuple, mt.score_candidates(mt.prepare(asked), verses, mt.PRODUCT).collect()))
    whole = rows()
    monkeypatch.setattr(mt, "HELD", held)
    monkeypatch.setattr(mt, "PAIRS_HELD", 1000)
    assert whole and rows() == whole


def test_texts_are_shuffled_once(spark, sf):
    """They were once by id and once by book."""
    plan = cp.build(load(spark, sf, "verses")).select("book", "idx", "norm")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(edition") == 1 and "hashpartitioning(book" not in plan


def test_redelivered_rows_in_several_books(spark):
    """The greatest row of an id stands for it, whatever books its rows are in; without a reference it is no verse."""
    columns = "verse_id long, edition string, surah int, ayah int, text_uthmani string, text_clean string, surah_name string, surah_name_en string"
    v = [(1, "a", 1, 1, "x", "", "", ""), (1, "b", 1, 1, "y", "", "", ""), (1, None, 9, 9, "z", "", "", ""), (2, "a", 1, 2, "k", None, "", ""), (2, "a", 1, 2, "m", None, "", "")]
    v += [(3, "b", None, 4, "n", "", "", ""), (3, "a", 1, 4, "n", "", "", ""), (4, "a", 1, 3, "p", "p", "", ""), (4, "a", 1, 3, "p", "p", "", ""), (None, "a", 1, 5, "r", "", "", "")]
    got = {(r.verse_id, r.book, r.surah, r.ayah, r.text_uthmani, r.idx) for r in cp.base(spark.createDataFrame(v, columns)).collect()}
    assert got == {(1, "b", 1, 1, "y", 0), (2, "a", 1, 2, "m", 0), (4, "a", 1, 3, "p", 1)}
