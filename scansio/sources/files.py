"""JSON sources (verses, layouts, samples, vocabulary, clip lists, reports, diagnostics) and the report sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSE = "surah int, ayah int, text_uthmani string, text_clean string, surah_name string, surah_name_en string"
PAGE = (
    "page int, lines array<struct<line:int,type:string,text:string,surah:string,verseRange:string,qpcV1:string,"
    "words:array<struct<location:string,word:string,qpcV1:string>>>>"
)
SAMPLE = "id string, file string, surah int, ayah int, ayah_end int, category string, source string, expected_verses array<struct<surah:int,ayah:int>>"
CLIP = "type string, file string, surah int, ayah int"
REPORT = "id string, surah int, ayah int, modelPrediction string, notes string, timestamp string, userAgent string, audioSizeBytes long"
DIAGNOSTIC = "id string, trigger string, events array<struct<timestamp:long,type:string,data:string>>, timestamp string, userAgent string, hasAudio boolean"


def verses(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of verses."""
    return spark.read.schema(VERSE).json(path, multiLine=True)


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """Page files, or one array of pages: rows in no order, `page` is the order."""
    return spark.read.schema(PAGE).json(path, multiLine=True).where("page IS NOT NULL")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a manifest."""
    return spark.read.schema(f"samples array<struct<{SAMPLE.replace(' array<struct<', ':array<struct<').replace(' int', ':int').replace(' string', ':string')}>>").json(path, multiLine=True).select(F.inline("samples"))


def clips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLIP).json(path, multiLine=True)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """`token, piece` of a JSON object of ids and pieces."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m"))
    return whole.select(F.explode("m").alias("token", "piece")).select(F.col("token").cast("int").alias("token"), "piece")


def metas(spark: SparkSession, path: str, schema: str = REPORT) -> DataFrame:
    """Meta files of reports or diagnostics, one to a folder; files that can't be read are left out."""
    return spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True).where("_broken IS NULL AND id IS NOT NULL").drop("_broken")


def diagnostics_list(spark: SparkSession, path: str) -> DataFrame:
    """The diagnostics of a folder without their events: `id, trigger, event_count, timestamp, userAgent, hasAudio`."""
    return metas(spark, path, DIAGNOSTIC).select("id", "trigger", F.coalesce(F.size("events"), F.lit(0)).alias("event_count"), "timestamp", "userAgent", "hasAudio")


def newest_first(reports: DataFrame) -> DataFrame:
    return reports.withColumn("at", F.try_to_timestamp("timestamp")).orderBy(F.desc_nulls_last("at"), "id")


def blob(spark: SparkSession, path: str, key: str) -> DataFrame:
    """`path, content` of the files of a key, `key.*` or those in the folder `key`; no row if there are none. Only these are
    listed and read. Keys are plain names: anything else finds nothing."""
    there = []
    if re.fullmatch("[A-Za-z0-9_-]+", key):
        for glob in (f"{path}/{key}.*", f"{path}/{key}/*"):
            at = spark._jvm.org.apache.hadoop.fs.Path(glob)
            if len(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []):
                there.append(glob)
    if not there:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(there).select("path", "content")


def write_reports(reports: DataFrame, path: str) -> None:
    """Valid reports (with surah and ayah, and a size that isn't negative) under a new id each, as JSON partitioned by day."""
    valid = reports.where("surah IS NOT NULL AND ayah IS NOT NULL AND coalesce(audioSizeBytes, 0) >= 0")
    stamped = valid.withColumn("id", F.uuid()).withColumn("timestamp", F.coalesce("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
    stamped.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").json(path)


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    """Diagnostics with a trigger and events, under a new id each; audio is optional."""
    valid = diagnostics.where("trigger IS NOT NULL AND events IS NOT NULL").withColumn("hasAudio", F.coalesce("hasAudio", F.lit(False)))
    valid.withColumn("id", F.uuid()).withColumn("timestamp", F.coalesce("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).write.mode("append").json(path)


def ranges(spark: SparkSession, wanted: list[tuple[int, int, int]]) -> DataFrame:
    """`surah, ayah` of ranges (surah, from, to), both ends included."""
    given = spark.createDataFrame([tuple(x) for x in wanted], "surah int, a int, b int")
    return given.where("a <= b").select("surah", F.explode(F.sequence("a", "b")).alias("ayah"))
