"""Nearest vectors by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of a block.
BLOCK = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """`query, key, cosine, place`: the k nearest of all vectors to each query vector, itself left out, exact.

    A stated query set meets all rows in blocks of about BLOCK queries, and the rows in as many parts as shuffles have
    partitions, so that a block is the work of many tasks; each passes on its k best. Vectors that are null or of length 0 have no neighbours and are none.
    """

    def unit(df: DataFrame) -> DataFrame:
        norm = F.sqrt(dot(F.col(vector), F.col(vector)))
        return df.withColumn("_n", norm).where("_n > 0").select(key, F.transform(vector, lambda x: x.cast("double") / F.col("_n")).alias("u"))

    q = unit(queries).select(F.col(key).alias("query"), F.col("u").alias("qu"))
    blocks = max(1, -(-q.count() // BLOCK))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = q.select("*", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = unit(vectors).select("*", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    scored = rows.join(asked, ["block", "part"]).where(F.col("query") != F.col(key)).select("query", key, dot(F.col("u"), F.col("qu")).alias("cosine"))
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), key)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
