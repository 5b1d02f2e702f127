"""Frequency of every distinct value or term: occurrences, records that hold it, and a mark for rare and common ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio.operators.dedup import one_per_id

#: A term is rare if fewer records hold it.
RARE_BELOW = 3
#: A term is common if a greater share of all records holds it.
COMMON_ABOVE = 0.10


def verse_terms(words: str = "text_words", norm: str = "text_norm") -> Column:
    """The elements of `words`, or where that is null the pieces of `norm` between single spaces; null and empty pieces
    are no terms."""
    raw = F.coalesce(F.col(words), F.split(F.col(norm), " "))
    return F.filter(raw, lambda t: t.isNotNull() & (t != ""))


def frequencies(records: DataFrame, key: str, terms: Column, total: Column, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """`term, occurrences, records, mark` of every distinct term.

    `records` has one row per `key`, `total` is their number. Counts are taken per record first; `groupBy(key, term)` needs no shuffle of its own
    where `records` is already partitioned by `key`. They are then combined by hash within each task, so that one row
    per distinct term and task is shuffled however common the term is. `mark` is 'rare' where fewer than `rare_below`
    records hold the term, else 'common' where more than `common_above` of all records do (records without terms
    count), else 'kept'. Null terms are left out; no records give no rows.
    """
    per_record = records.select(key, F.explode(terms).alias("term")).where(F.col("term").isNotNull()).groupBy(key, "term").agg(F.count(F.lit(1)).alias("c"))
    counted = per_record.groupBy("term").agg(F.sum("c").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * total, "common").otherwise("kept")
    return counted.withColumn("mark", mark)


def number_of(df: DataFrame, key: str) -> Column:
    """The number of distinct keys, from a scan of the key alone."""
    return df.agg(F.countDistinct(key)).scalar()


def verse_word_frequencies(verses: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """`frequencies` of the words of verses; rows redelivered under the same verse_id are one record."""
    return frequencies(one_per_id(verses, "verse_id", "text_words", "text_norm"), "verse_id", verse_terms(), number_of(verses, "verse_id"), rare_below, common_above)


def verse_value_frequencies(verses: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """`frequencies` of whole text_norm values; missing and empty values are no terms."""
    value = F.when(F.col("text_norm") != "", F.array("text_norm"))
    return frequencies(one_per_id(verses, "verse_id", "text_norm"), "verse_id", value, number_of(verses, "verse_id"), rare_below, common_above)
