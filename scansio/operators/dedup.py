"""Redelivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_id(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per `key` with `columns` (all others are pruned before the shuffle).

    A redelivered row has the content of the first, so any row stands for the record; where contents differ all the
    same, the greatest by Spark's ordering wins, whatever the order of arrival. Rows with a null key are no records and
    are left out. An empty table gives an empty result.
    """
    picked = df.select(key, *columns).where(F.col(key).isNotNull())
    if len(columns) == 0:
        return picked.distinct()
    return picked.groupBy(key).agg(F.max(F.struct(*columns)).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in columns])
