from pyspark.sql import functions as F

from scansio.functions import text as tx
from scansio.functions.pytext import normalized

GOLDEN = [
    ("بِسْمِ ٱللَّهِ ٱلرَّحْمَٰنِ ٱلرَّحِيمِ", "بسم الله الرحمن الرحيم"),
    ("▁a▁b", "a b"),
    ("﻿أإآٱ ة ى", "اااا ه ي"),
    ("كـتـاب، هل؟ a.b!c:", "كتاب هل abc"),
    ("x    y", "x y"),
    ("", ""),
    ("  ", ""),
]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<int>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_normalisation(spark):
    df = spark.createDataFrame([(a,) for a, _ in GOLDEN], "t string").select("t", tx.normalize(F.col("t")).alias("n"))
    got = {r["t"]: r["n"] for r in df.collect()}
    for a, b in GOLDEN:
        assert got[a] == b == normalized(a)
        assert normalized(b) == b
    assert one(spark, tx.normalize(F.col("t")), t=None) is None


def test_first_opening_only(spark):
    o = tx.OPENING
    rows = [(f"{o} a {o}", 2, 1), (f"{o} a", 1, 1), (f"{o} a", 9, 1), (f"{o} a", 2, 2), (o, 2, 1), ("a", 2, 1)]
    df = spark.createDataFrame(rows, "n string, s int, a int").select(tx.without_opening(F.col("n"), F.col("s"), F.col("a")).alias("x"))
    assert [r["x"] for r in df.collect()] == [f"a {o}", None, None, None, None, "a"]


def test_trigrams_of_short_texts(spark):
    assert [one(spark, tx.trigrams(F.col("t")), t=t) for t in ("", "ab", "abc", "abcabc")] == [[], [], ["abc"], ["abc", "bca", "cab"]]


def test_small_functions(spark):
    assert one(spark, tx.words(F.col("t")), t="") == [""]
    assert one(spark, tx.key_part(F.col("t"), 2), t="1:2") is None
    assert one(spark, tx.key_part(F.col("t"), 1), t="1:x:3") is None
    assert one(spark, tx.arabic_number(F.col("n")), n=120) == "١٢٠"
    assert one(spark, tx.page_name(F.col("n")), n=7) == "007"
    assert one(spark, tx.display_words(F.col("t")), t="a b ۖ c") == ["a", "b ۖ", "c"]
    assert one(spark, tx.shared_prefix(F.split(F.col("a"), " "), F.split(F.col("b"), " ")), a="x y z", b="x y") == 2
    assert one(spark, tx.confidence_band(F.lit(0.4)), n=1) == "warn"
    assert one(spark, tx.relative_band(F.lit(0.0), F.lit(0.0)), n=1) == "other"
    assert one(spark, tx.rounded(F.lit(0.0005), 3), n=1) == 0.001
