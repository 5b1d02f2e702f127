"""Recordings as paced streams of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples of a chunk: a tenth of a second.
CHUNK_SAMPLES = 1_600


def chunked(recordings: DataFrame, size: int = CHUNK_SAMPLES) -> DataFrame:
    """`session_id, seq, samples` of recordings `session_id, samples`: chunks of `size` samples in order, the last as it is."""
    n = F.ceil(F.size("samples") / F.lit(size)).cast("int")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col("samples"), i * size + 1, F.lit(size)))).alias("seq", "samples")
    return recordings.where(F.size("samples") > 0).select("session_id", at).select("session_id", F.col("seq").cast("long").alias("seq"), "samples")


def written_for_replay(chunks: DataFrame, path: str, per_file: int = 10) -> None:
    """Chunks as files of `per_file` numbers each, in the order in which they are to be read: file times follow the numbers."""
    step = chunks.withColumn("step", F.floor(F.col("seq") / F.lit(per_file)).cast("int"))
    last = step.agg(F.max("step")).first()[0]
    for k in range(0 if last is None else last + 1):  # one write a step of the clock, each distributed over its sessions
        step.where(F.col("step") == k).drop("step").write.mode("append").parquet(path)


def replayed(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """The stream of such files, `files` a trigger; a trigger of `chunk time * per_file / speed` plays them at that speed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", False).parquet(path)
