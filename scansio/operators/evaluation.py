"""Evaluation of predictions against expected references.

`predictions`: qid, surah, ayah, ayah_end (null for a single verse), score and, where it is known, time_ms; no row where
there is no answer.
`expected`: qid, surah, ayah, one row for each expected verse in `pos`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scansio.functions.score import ratio

#: Classes from best to worst; lenient accuracy counts all but the last three.
CLASSES = ("exact", "equivalent", "within1", "within2", "same_surah", "wrong", "no_match")


def first_expected(samples: DataFrame) -> DataFrame:
    """`qid, surah, ayah, n` of samples' arrays of expected verses: the first, and how many there are."""
    e = F.col("expected_verses")
    return samples.select(F.col("sample_id").alias("qid"), e[0]["surah"].alias("surah"), e[0]["ayah"].alias("ayah"), F.size(e).alias("n"))


def expected_rows(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("sample_id").alias("qid"), "category", "source", F.posexplode("expected_verses").alias("pos", "v")).select("qid", "category", "source", "pos", "v.*")


def _class(surah: Column, ayah: Column, p_surah: Column, p_ayah: Column, p_end: Column, equivalent: Column) -> Column:
    inside = (surah == p_surah) & ayah.between(p_ayah, F.coalesce(p_end, p_ayah))
    off = F.abs(ayah - p_ayah)
    return (
        F.when(p_surah.isNull(), "no_match")
        .when(inside, "exact")
        .when(F.coalesce(equivalent, F.lit(False)), "equivalent")
        .when((surah == p_surah) & (off <= 1), "within1")
        .when((surah == p_surah) & (off <= 2), "within2")
        .when(surah == p_surah, "same_surah")
        .otherwise("wrong")
    )


def classify(samples: DataFrame, predictions: DataFrame, equivalents: DataFrame | None = None) -> DataFrame:
    """`qid, category, source, surah, ayah, class` by the first expected verse. `equivalents` are pairs of references
    (surah, ayah, other_surah, other_ayah) of equal text; they count inside the same surah only."""
    want = expected_rows(samples).where("pos = 0")
    times = [c for c in ("time_ms",) if c in predictions.columns]
    p = predictions.select("qid", F.col("surah").alias("p_surah"), F.col("ayah").alias("p_ayah"), F.col("ayah_end").alias("p_end"), *times)
    met = want.join(p, "qid", "left")
    if equivalents is None:
        met = met.withColumn("eq", F.lit(False))
    else:
        eq = equivalents.where("surah = other_surah").select("surah", "ayah", F.col("other_surah").alias("p_surah"), F.col("other_ayah").alias("p_ayah"), F.lit(True).alias("eq")).distinct()
        met = met.join(eq, ["surah", "ayah", "p_surah", "p_ayah"], "left")
    c = F.col
    return met.select("qid", "category", "source", "surah", "ayah", _class(c("surah"), c("ayah"), c("p_surah"), c("p_ayah"), c("p_end"), c("eq")).alias("class"), *times)


def similar_refs(samples: DataFrame, predictions: DataFrame, corpus: DataFrame, above: float = 0.95) -> DataFrame:
    """`surah, ayah, other_surah, other_ayah` of expected and predicted references of one surah whose texts without opening
    and spaces (`no_bsm_ns`, or else `ns`) have a ratio above `above` in some book."""
    text = F.coalesce("no_bsm_ns", "ns")
    asked = expected_rows(samples).select("qid", "surah", "ayah").join(predictions.select("qid", "surah", F.col("ayah").alias("other_ayah")), ["qid", "surah"]).select("surah", "ayah", "other_ayah").where("ayah <> other_ayah").distinct()
    a = corpus.select("book", "surah", "ayah", text.alias("a"))
    b = corpus.select("book", "surah", F.col("ayah").alias("other_ayah"), text.alias("b"))
    near = asked.join(a, ["surah", "ayah"]).join(b, ["book", "surah", "other_ayah"]).where(ratio(F.col("a"), F.col("b")) > above)
    return near.select("surah", "ayah", F.col("surah").alias("other_surah"), "other_ayah").distinct()


FIVE = ("correct", "equiv", "adjacent", "wrong", "no_match")


def classify_five(samples: DataFrame, predictions: DataFrame, equivalents: DataFrame) -> DataFrame:
    """`qid, category, source, class` of FIVE, the best that any expected verse of the predicted surah gives: in the run, of
    equal text with its first verse, or next to either of its ends."""
    p = predictions.select("qid", F.col("surah").alias("p_surah"), F.col("ayah").alias("p_ayah"), F.coalesce("ayah_end", "ayah").alias("p_end"))
    eq = equivalents.where("surah = other_surah").select("surah", "ayah", F.col("other_ayah").alias("p_ayah"), F.lit(True).alias("eq")).distinct()
    met = expected_rows(samples).join(p, "qid", "left").join(eq, ["surah", "ayah", "p_ayah"], "left")
    near = (F.abs(F.col("ayah") - F.col("p_ayah")) <= 1) | (F.abs(F.col("ayah") - F.col("p_end")) <= 1)
    rank = F.when(F.col("p_surah").isNull(), 4).when(F.col("surah") != F.col("p_surah"), 3).when(F.col("ayah").between(F.col("p_ayah"), F.col("p_end")), 0).when(F.col("eq"), 1).when(near, 2).otherwise(3)
    best = met.groupBy("qid", "category", "source").agg(F.min(rank).alias("r"))
    return best.select("qid", "category", "source", F.element_at(F.array(*map(F.lit, FIVE)), F.col("r") + 1).alias("class"))


def accuracy(classified: DataFrame, by: str) -> DataFrame:
    """`by, n, exact, lenient`, with time_ms also `avg_ms`, and a row with null `by` for all (rollup)."""
    times = [F.avg("time_ms").alias("avg_ms")] if "time_ms" in classified.columns else []
    of = lambda *names: F.avg(F.col("class").isin(*names).cast("int"))
    return classified.rollup(by).agg(F.count(F.lit(1)).alias("n"), of("exact").alias("exact"), of(*CLASSES[:4]).alias("lenient"), *times)


def class_table(classified: DataFrame, by: str) -> DataFrame:
    """One row for each `by`, one column of counts for each class."""
    return classified.groupBy(by).agg(*[F.count_if(F.col("class") == k).alias(k) for k in CLASSES])


def surah_band(surah: Column) -> Column:
    return F.when(surah >= 78, "78+").when(surah >= 11, "11-77").otherwise("1-10")


def span_coverage(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """`qid, n, covered`: of each sample's expected verses, how many lie in the predicted run."""
    p = predictions.select("qid", F.col("surah").alias("p_surah"), F.col("ayah").alias("p_ayah"), F.col("ayah_end").alias("p_end"))
    met = expected_rows(samples).join(p, "qid", "left")
    inside = (F.col("surah") == F.col("p_surah")) & F.col("ayah").between(F.col("p_ayah"), F.coalesce("p_end", "p_ayah"))
    return met.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("covered"))


def first_matches(expected: DataFrame, messages: DataFrame) -> DataFrame:
    """`session_id, surah, ayah, first_seq` of expected refs of a session and the first match message of each, null if
    none."""
    m = messages.where("msg_type = 'verse_match'").groupBy("session_id", "surah", "ayah").agg(F.min("seq").alias("first_seq"))
    return expected.join(m, ["session_id", "surah", "ayah"], "left")


def unexpected_matches(expected: DataFrame, messages: DataFrame) -> DataFrame:
    """Match messages of references that their session doesn't expect."""
    m = messages.where("msg_type = 'verse_match'").select("session_id", "seq", "surah", "ayah")
    return m.join(expected.select("session_id", "surah", "ayah"), ["session_id", "surah", "ayah"], "left_anti")


def full_clip(clips: DataFrame) -> DataFrame:
    """`file, full_file` of partial clips and the full clip of the same reference (null if there is none)."""
    full = clips.where("type = 'full'").groupBy("surah", "ayah").agg(F.min("file").alias("full_file"))
    return clips.where("type <> 'full'").join(full, ["surah", "ayah"], "left").select("file", "type", "surah", "ayah", "full_file")


def better_of(first: DataFrame, second: DataFrame, below: float = 0.85, gain: float = 0.05) -> DataFrame:
    """Predictions of a cheap pass, replaced by those of a costly one where the cheap score is below `below` and the other
    wins by more than `gain`; a missing answer scores 0."""
    names = ["surah", "ayah", "ayah_end", "score"]
    a = first.select("qid", F.struct(*names).alias("a"))
    b = second.select("qid", F.struct(*names).alias("b"))
    sa, sb = F.coalesce("a.score", F.lit(0.0)), F.coalesce("b.score", F.lit(0.0))
    return a.join(b, "qid", "full").select("qid", F.when((sa < below) & (sb > sa + gain), F.col("b")).otherwise(F.col("a")).alias("r")).select("qid", "r.*").where("score IS NOT NULL")


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """`n` rows in a seeded random order, the same for the same rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def scenario_rollup(rows: DataFrame) -> DataFrame:
    """`scenario, verses, discovered, discovery_rate, coverage` of rows scenario, discovered, words_covered, words_total, and
    with time_ms also `avg_ms, sum_ms`: the mean coverage is over verses with words."""
    times = [F.avg("time_ms").alias("avg_ms"), F.sum("time_ms").alias("sum_ms")] if "time_ms" in rows.columns else []
    part = F.when(F.col("words_total") > 0, F.col("words_covered") / F.col("words_total"))
    return rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("verses"), F.count_if("discovered").alias("discovered"), F.avg(F.col("discovered").cast("int")).alias("discovery_rate"), F.avg(part).alias("coverage"), *times)


def clips_for(expected: DataFrame, clips: DataFrame) -> DataFrame:
    """`scenario, place, surah, ayah, file`: the clips of expected references (scenario, pos, surah, ayah) in their order, those
    without a clip left out; of several clips of a reference the first by name."""
    one = clips.groupBy("surah", "ayah").agg(F.min("file").alias("file"))
    place = F.row_number().over(Window.partitionBy("scenario").orderBy("pos")) - 1
    return expected.join(one, ["surah", "ayah"]).select("scenario", place.alias("place"), "surah", "ayah", "file")


def criteria(rows: DataFrame) -> DataFrame:
    """`scenario, passed, n, all_pass, any_pass` of criteria rows scenario, pass."""
    return rows.groupBy("scenario").agg(F.count_if("pass").alias("passed"), F.count(F.lit(1)).alias("n"), F.bool_and("pass").alias("all_pass"), F.bool_or("pass").alias("any_pass"))


