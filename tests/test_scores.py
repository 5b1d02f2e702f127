import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scansio.functions import distance as ds
from scansio.functions import score as sc

words = st.text("abم ", max_size=12)
longer = st.text("abcم ", max_size=150)


def table(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@given(longer, longer)
@settings(max_examples=60, deadline=None)
def test_distance_is_that_of_the_table(a, b):
    d = table(a, b)
    assert sc.distance_of(a, b) == d == ds.distances(a, [b, ""])[0][0]
    assert sc.ratio_of(a, b) == sc.ratio_of(b, a)
    assert 0 <= sc.ratio_of(a, b) <= 1


@given(words, words)
@settings(max_examples=60, deadline=None)
def test_semi_global_is_the_best_stretch(q, t):
    best = min(table(q, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
    assert sc.semi_global_of(q, t) == best == ds.distances(q, [t], anchored=False)[1][0]
    assert sc.semi_global_of(q, t) <= sc.distance_of(q, t)
    if q:
        assert (sc.fragment_of(q, t) == 1) == (q in t)


def test_golden():
    assert (sc.ratio_of("", ""), sc.ratio_of("", "abc"), sc.ratio_of("abc", "xyz")) == (1, 0, 0.5)
    assert sc.ratio_of("kitten", "sitting") == pytest.approx(10 / 13)
    assert (sc.fragment_of("bcd", "abcde"), sc.fragment_of("abc", ""), sc.fragment_of("", "a")) == (1, 0, 1)
    assert (sc.partial_ratio_of("abc", "xabcx"), sc.partial_ratio_of("", "a")) == (1, 0)
    assert not sc.words_match_of("ab", "ac") and sc.words_match_of("abcd", "abce")
    assert sc.window_match_of("b c".split(), "a b c d".split()) == (1.0, 1, 3)
    assert sc.window_match_of([], ["a"]) == (0.0, 0, 0)
    assert sc.align_of("b d".split(), "a b c d".split()) == [1, 3]
    assert sc.align_of(["zzz"], "a b c d e f zzz".split()) == []  # beyond the look-ahead
    assert sc.char_progress_of("abcdefgh", "abcd efgh ijkl", "abcd efgh ijkl".split()) == 1
    assert sc.char_progress_of("ab", "abcd", ["abcd"]) == -1


def test_columns_agree_with_python(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("", "abc"), ("abc", ""), ("ab", "ac"), ("abcd", "xabcex"), (None, "a"), ("مرحبا", "مرحبه")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", sc.ratio(a, b).alias("r"), sc.partial_ratio(a, b).alias("p"), sc.words_match(a, b).alias("m"), sc.word_similarity(a, b).alias("w"), sc.fragment(a, b).alias("f"), sc.semi_global(a, b).alias("g")).collect()
    for r in rows:
        if r["a"] is None:
            assert r["r"] is None and r["f"] is None
            continue
        x = (r["a"], r["b"])
        assert r["r"] == pytest.approx(sc.ratio_of(*x)) and r["p"] == pytest.approx(sc.partial_ratio_of(*x))
        assert r["m"] == sc.words_match_of(*x) and r["w"] == pytest.approx(sc.word_similarity_of(*x))
        assert r["f"] == pytest.approx(sc.fragment_of(*x)) and r["g"] == sc.semi_global_of(*x)


def test_suffix_prefix(spark):
    df = spark.createDataFrame([("x a b c", "a b c d"), ("a", "a b")], "a string, b string")
    got = [r[0] for r in df.select(sc.suffix_prefix(F.split("a", " "), F.split("b", " "))).collect()]
    assert got == [1.0, 0.0]
