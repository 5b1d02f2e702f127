"""Analytics of ordered message streams: by session and `seq`, the order in which they were sent.

A message sent again under the same (session_id, seq) is one message: the row with the least msg_id counts. A session may
hold a great part of all rows, so none is brought into order as a whole: it is cut into stretches of STRETCH numbers, each
of which is a key of its own; what one stretch needs of those before it (their counts, their last rows) is a row a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of the trailing window of rapid switching, and of the pause after a report.
SWITCH_MS, COOLDOWN_MS = 10_000, 30_000
#: Numbers of a session that are brought into order together.
STRETCH = 10_000
#: Milliseconds after a verse is reached in which missing words say nothing.
GRACE_MS = 2_000


def _stretch() -> Column:
    return F.floor(F.col("seq") / F.lit(STRETCH)).alias("_b")


def running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows of a session up to each row, in the order of `seq`."""
    rows = df.withColumn("_v", value.cast("long")).withColumn("_b", _stretch())
    before = F.sum("_s").over(Window.partitionBy("session_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("session_id", "_b").agg(F.sum("_v").alias("_s")).select("session_id", "_b", F.coalesce(before, F.lit(0)).alias("_o"))
    inner = F.sum("_v").over(Window.partitionBy("session_id", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_i", inner).join(offsets, ["session_id", "_b"]).withColumn(name, F.col("_i") + F.col("_o")).drop("_v", "_b", "_i", "_o")


def back(df: DataFrame, column: str, *names: str) -> DataFrame:
    """`df` with the values of `column` one, two and so on rows before in the session, under `names`; null where there are
    none. Of the stretches before, the last rows are carried over: each has at least one, so as many stretches will do."""
    k = len(names)
    rows = df.withColumn("_b", _stretch())
    own = Window.partitionBy("session_id", "_b").orderBy("seq")
    last = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("seq", F.col(column).alias("v"))))), 1, k)  # of at most STRETCH rows
    tails = rows.groupBy("session_id", "_b").agg(last.alias("_t"))
    order = Window.partitionBy("session_id").orderBy("_b")
    none = F.array().cast(tails.schema["_t"].dataType)
    carried = tails.select("session_id", "_b", F.concat(*[F.coalesce(F.lag("_t", j).over(order), none) for j in range(1, k + 1)]).alias("_c"))
    inner = rows.select("*", F.row_number().over(own).alias("_n"), *[F.lag(column, j).over(own).alias(f"_l{j}") for j in range(1, k + 1)])
    met = inner.join(carried, ["session_id", "_b"])
    for j, name in enumerate(names, 1):
        met = met.withColumn(name, F.when(F.col("_n") > j, F.col(f"_l{j}")).otherwise(F.get("_c", F.lit(j) - F.col("_n"))["v"]))
    return met.drop("_b", "_n", "_c", *[f"_l{j}" for j in range(1, k + 1)])


def messages(raw: DataFrame) -> DataFrame:
    """One row for each (session_id, seq)."""
    first = raw.where("session_id IS NOT NULL AND seq IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("session_id", "seq").orderBy("msg_id")))
    return first.where("_n = 1").drop("_n")


def placed(m: DataFrame) -> DataFrame:
    """Messages with `pos`, the place of each among all of its session from 0."""
    return running(m, F.lit(1), "pos").withColumn("pos", (F.col("pos") - 1).cast("int"))


def matches(m: DataFrame) -> DataFrame:
    return m.where("msg_type = 'verse_match' AND surah IS NOT NULL AND ayah IS NOT NULL").withColumn("ref", F.concat_ws(":", "surah", "ayah"))


def progress(m: DataFrame) -> DataFrame:
    return m.where("msg_type = 'word_progress' AND surah IS NOT NULL AND ayah IS NOT NULL").withColumn("ref", F.concat_ws(":", "surah", "ayah"))


def with_last_match(m: DataFrame, kind: str) -> DataFrame:
    """Messages of a kind with `last_surah, last_ayah` of the last match before each in its session, null if there is none:
    the match of the number that the matches up to there count."""
    is_match = (F.col("msg_type") == "verse_match") & F.col("surah").isNotNull() & F.col("ayah").isNotNull()
    counted = running(m, F.when(is_match, 1).otherwise(0), "k")
    last = matches(counted).select("session_id", "k", F.col("surah").alias("last_surah"), F.col("ayah").alias("last_ayah"))
    return counted.where(F.col("msg_type") == kind).join(last, ["session_id", "k"], "left").drop("k")


def type_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"))


def distinct_refs(m: DataFrame) -> DataFrame:
    return matches(m).groupBy("session_id").agg(F.countDistinct("ref").alias("refs"))


def oscillation(m: DataFrame) -> DataFrame:
    """`session_id, from_ref, to_ref, n`: how often matches went A, B, A."""
    s = back(matches(m).select("session_id", "seq", "ref"), "ref", "b", "a")
    return s.where("ref = a AND ref <> b").groupBy("session_id", F.col("a").alias("from_ref"), F.col("b").alias("to_ref")).agg(F.count(F.lit(1)).alias("n"))


def regressions(m: DataFrame) -> DataFrame:
    """`session_id, ref, pos, max_seen, word_index` of progress messages of a verse that fall behind an earlier one."""
    w = Window.partitionBy("session_id", "ref").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return progress(placed(m)).withColumn("max_seen", F.max("word_index").over(w)).where("word_index < max_seen").select("session_id", "ref", "pos", "max_seen", "word_index")


def in_order(m: DataFrame) -> DataFrame:
    """`session_id, in_order`: whether all matches are of one surah with ayahs that never fall."""
    s = back(matches(m).select("session_id", "seq", "surah", F.struct("surah", "ayah").alias("at")), "at", "before")
    s = s.select("session_id", ((F.col("surah") == F.col("before.surah")) & (F.col("at.ayah") >= F.col("before.ayah"))).alias("ok"))
    return s.groupBy("session_id").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("in_order"))


def latency(m: DataFrame) -> DataFrame:
    """`session_id, first_match`: the place of the first match in the whole stream, which is how many messages come before it;
    -1 if there is none. Counted in parts: no session is brought into order."""
    first = matches(m).groupBy("session_id").agg(F.min("seq").alias("at"))
    counted = m.select("session_id", "seq").join(first, "session_id", "left").groupBy("session_id").agg(F.max("at").alias("at"), F.count_if(F.col("seq") < F.col("at")).alias("n"))
    return counted.select("session_id", F.when(F.col("at").isNull(), -1).otherwise(F.col("n")).cast("int").alias("first_match"))


def settles(m: DataFrame) -> DataFrame:
    """`session_id, settled`: whether the last three matches name one verse, or there are no three."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    last = matches(m).withColumn("b", back).where("b <= 3")
    return last.groupBy("session_id").agg(((F.count(F.lit(1)) <= 2) | (F.countDistinct("ref") <= 1)).alias("settled"))


def changes(m: DataFrame) -> DataFrame:
    """`session_id, seq, ref` of matches that differ from the match before."""
    return back(matches(m).select("session_id", "seq", "ref"), "ref", "prev").where("prev IS NULL OR prev <> ref").select("session_id", "seq", "ref")


def top_relative(m: DataFrame) -> DataFrame:
    """`session_id, seq, confidence, share, band` of matches: confidence by that of the session's best."""
    from scansio.functions.text import relative_band, rounded

    own = matches(m).where("confidence IS NOT NULL")
    s = own.join(own.groupBy("session_id").agg(F.max("confidence").alias("top")), "session_id")
    return s.select("session_id", "seq", "confidence", rounded(F.when(F.col("top") > 0, F.col("confidence") / F.col("top")), 3).alias("share"), relative_band(F.col("confidence"), F.col("top")).alias("band"))


def triggers(m: DataFrame) -> DataFrame:
    """`session_id, seq, ms, trigger` of matches at which something is wrong: 'surah_jump' where the surah differs from
    the match before, else 'rapid_switching' where at least three verses were matched in the last ten seconds. Matches
    without a time are no triggers of the second kind; the order of a window of time is by time."""
    s = back(matches(m).where("ts IS NOT NULL").select("session_id", "seq", "surah", "ref", _ms().alias("ms")), "surah", "prev")
    # Each row stands in the window of its own SWITCH_MS and, for others to see, in the next: a window ends in either.
    span = F.floor(F.col("ms") / F.lit(SWITCH_MS))
    both = s.select("*", F.posexplode(F.array(span, span + 1)).alias("later", "part"))
    last10 = Window.partitionBy("session_id", "part").orderBy("ms").rangeBetween(-(SWITCH_MS - 1), 0)
    t = both.withColumn("refs", F.size(F.collect_set("ref").over(last10))).where("later = 0")
    kind = F.when(F.col("prev") != F.col("surah"), "surah_jump").when(F.col("refs") >= 3, "rapid_switching")
    return t.withColumn("trigger", kind).where("trigger IS NOT NULL").select("session_id", "seq", "ms", "trigger")


def cooled_down(fired: DataFrame) -> DataFrame:
    """The triggers that are reported: after one, none of the session for 30 seconds. Each decision rests on the last
    report, so a session's triggers pass in order, batch by batch; only the time of the last report is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, last = None, None
        for pdf in batches:
            sent = []
            for own, ms in zip(pdf["session_id"], pdf["ms"]):
                if own != session:
                    session, last = own, None
                sent.append(last is None or ms - last >= COOLDOWN_MS)
                if sent[-1]:
                    last = ms
            yield pdf[sent]

    ordered = fired.select("session_id", "seq", "ms", "trigger").repartition("session_id").sortWithinPartitions("session_id", "ms", "seq", "trigger")
    return ordered.mapInPandas(run, "session_id long, seq long, ms long, trigger string")


def idle(m: DataFrame, quiet_ms: int = 1_500, most_ms: int = 60_000) -> DataFrame:
    """`session_id, idle_at, timed_out`: when a session that is listened to is given up as idle: the first time that nothing
    follows a message for `quiet_ms`, or `most_ms` after its first message. Messages without a time don't count."""
    timed = m.select("session_id", "seq", _ms().alias("ms")).where("ms IS NOT NULL")
    order = Window.partitionBy("session_id").orderBy("ms", "seq")
    gap = timed.withColumn("next", F.lead("ms").over(order)).withColumn("quiet", F.when(F.col("next").isNull() | (F.col("next") - F.col("ms") >= quiet_ms), F.col("ms") + quiet_ms))
    each = gap.groupBy("session_id").agg(F.min("quiet").alias("q"), (F.min("ms") + most_ms).alias("end"))
    return each.select("session_id", F.least("q", "end").alias("idle_at"), (F.col("q") > F.col("end")).alias("timed_out"))


def newest(m: DataFrame, n: int = 50) -> DataFrame:
    """`session_id, seq, msg_type, back`: the newest messages of each session, the newest first (back = 1)."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    return m.withColumn("back", back).where(F.col("back") <= n).select("session_id", "seq", "msg_type", "back")


def last_transcripts(m: DataFrame, n: int = 5) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    return m.where("msg_type = 'raw_transcript'").withColumn("back", back).where(F.col("back") <= n).select("session_id", "seq", "text", "back")


# --- words of a verse ---------------------------------------------------------------------------------------------------


def contiguous_prefix(indices: Column) -> Column:
    """The greatest k with 0..k all in the array; -1 if 0 isn't. In order, a distinct value is at its own place as long as
    nothing is missing before it."""
    own = F.array_sort(F.array_distinct(F.filter(indices, lambda x: x >= 0)))
    gap = F.array_position(F.transform(own, lambda x, i: x == i), False)
    return (F.when(gap == 0, F.size(own)).otherwise(gap - 1) - 1).cast("int")


def skipped(indices: Column, prefix: Column, excluded: Column | None = None, since_ms: Column | None = None) -> Column:
    """The places of the first gap, where at least two words lie beyond it and the prefix holds more than the first word;
    without `excluded` places, and none in the first GRACE_MS after the verse was reached, where `since_ms` is known."""
    beyond = F.filter(indices, lambda x: x > prefix + 1)
    gap = F.sequence(prefix + 1, F.array_min(beyond) - 1)
    settled = F.lit(True) if since_ms is None else F.coalesce(since_ms >= GRACE_MS, F.lit(True))
    found = F.when((prefix >= 1) & (F.size(beyond) >= 2) & settled, gap)
    return F.array_except(found, excluded) if excluded is not None else found


def _ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def first_on_page(m: DataFrame, pages: DataFrame) -> DataFrame:
    """`session_id, edition, seq, page, first`: the page of each match in every edition that shows its verse (edition, surah,
    ayah, page), and whether it is the first after another page or none."""
    at = matches(m).select("session_id", "seq", "surah", "ayah").join(pages, ["surah", "ayah"])
    before = F.lag("page").over(Window.partitionBy("session_id", "edition").orderBy("seq"))
    return at.select("session_id", "edition", "seq", "page", F.coalesce(before != F.col("page"), F.lit(True)).alias("first"))


def covered_words(m: DataFrame) -> DataFrame:
    """`session_id, ref, run, indices, total, run_ms` of progress: the words matched in each run of messages of one verse, the
    last total, and the time from its first to its last message. A run ends where another verse is read."""
    p = progress(m)
    new = F.when(F.col("before") == F.col("ref"), 0).otherwise(1)
    runs = running(back(p.select("session_id", "seq", "ref", "matched_indices", "total_words", "ts"), "ref", "before"), new, "run")
    each = runs.groupBy("session_id", "ref", "run").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_indices")))).alias("indices"), F.max_by("total_words", "seq").alias("total"), (F.max(_ms()) - F.min(_ms())).alias("run_ms"))
    return each


def word_coverage(m: DataFrame) -> DataFrame:
    """`session_id, ref, words, total, coverage`: distinct words matched of each verse in a session, by its last total."""
    p = progress(m)
    total = p.groupBy("session_id", "ref").agg(F.max_by("total_words", "seq").alias("total"))
    hit = p.select("session_id", "ref", F.explode("matched_indices").alias("i")).groupBy("session_id", "ref").agg(F.countDistinct("i").alias("words"))
    met = total.join(hit, ["session_id", "ref"], "left").withColumn("words", F.coalesce("words", F.lit(0)))
    return met.withColumn("coverage", F.when(F.col("total") > 0, F.least(F.col("words") / F.col("total"), F.lit(1.0))))
