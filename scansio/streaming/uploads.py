"""Diagnostic uploads, and the sink of outbound messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from scansio.functions.signal import RATE

#: Samples of sound that go with a report, and messages.
MOST_SAMPLES, MOST_MESSAGES = 30 * RATE, 50


def uploads(fired: DataFrame, m: DataFrame, chunks: DataFrame) -> DataFrame:
    """`session_id, seq, trigger, events, samples` of triggers (session_id, seq, trigger): the last MOST_MESSAGES messages up
    to each (seq, msg_type, text), and the last MOST_SAMPLES samples of its chunks (session_id, seq, samples) up to then.

    A trigger meets the chunks of two stretches of as many samples as it may take, and the messages of two stretches of as
    many messages, by their numbers; so no trigger meets a whole session. Without chunks samples are null.
    """
    upto = Window.partitionBy("session_id").orderBy("seq")
    asked = fired.select("session_id", "seq", "trigger")

    def placed(rows: DataFrame, size) -> DataFrame:
        """Rows with the running sum of their size and its stretch; and each trigger with the sum that it stands at."""
        return rows.withColumn("end", F.sum(size).over(upto))

    def joined(rows: DataFrame, most: int, value) -> DataFrame:
        # The trigger's own end is that of the last row up to it: the triggers stand among the rows.
        marks = rows.select("session_id", "seq", "end").unionByName(asked.select("session_id", "seq", F.lit(None).cast("long").alias("end")).distinct())
        at = marks.withColumn("at", F.max("end").over(upto.rangeBetween(Window.unboundedPreceding, 0))).where("end IS NULL AND at IS NOT NULL").select("session_id", "seq", "at")
        stretch = F.floor((F.col("end") - 1) / F.lit(most))
        reach = at.select("session_id", F.col("seq").alias("t_seq"), "at", F.explode(F.array(F.floor((F.col("at") - 1) / F.lit(most)), F.floor((F.col("at") - 1) / F.lit(most)) - 1)).alias("part"))
        met = rows.withColumn("part", stretch).join(reach, ["session_id", "part"]).where((F.col("end") <= F.col("at")) & (F.col("end") > F.col("at") - most))
        return met.groupBy("session_id", F.col("t_seq").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("seq", value.alias("v")))).alias("rows"))

    messages = joined(placed(m.select("session_id", "seq", "msg_type", "text"), F.lit(1).cast("long")), MOST_MESSAGES, F.struct("msg_type", "text"))
    sounds = joined(placed(chunks.where(F.size("samples") > 0).select("session_id", "seq", "samples"), F.size("samples").cast("long")), MOST_SAMPLES, F.col("samples"))
    events = F.transform("rows", lambda r: F.struct(r["seq"].alias("seq"), r["v"]["msg_type"].alias("msg_type"), r["v"]["text"].alias("text")))
    samples = F.slice(F.reverse(F.flatten(F.transform("rows", lambda r: r["v"]))), 1, MOST_SAMPLES)
    with_events = asked.join(messages.select("session_id", "seq", events.alias("events")), ["session_id", "seq"], "left")
    return with_events.join(sounds.select("session_id", "seq", F.reverse(samples).alias("samples")), ["session_id", "seq"], "left")


def posted(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A sink of the outbound messages of a stream: each batch is appended to `path`, a session's messages together and in
    order (session_id, seq, n). The caller sets the trigger and starts it."""

    def write(batch: DataFrame, _: int) -> None:
        batch.repartition("session_id").sortWithinPartitions("session_id", "seq", "n").write.mode("append").parquet(path)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
