"""Filling containers of fixed capacity: shortest-pack-first over the histogram of sizes.

The placing looks at sizes only, of which there are no more than the capacity, so the driver's work and what it holds
are bounded by the capacity and not by the data. Items meet their places by rank: the k-th item of a size takes the
k-th place for that size.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scansio.llm.tokens import count_tokens
from scansio.session import cut

#: Tokens of a container.
CAPACITY = 2048
#: Items of a size that are numbered in one part; a hot size is the work of many tasks, not of one.
PART_ROWS = 200_000


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of sizes, each with the number of containers filled by it.

    Sizes are placed longest first. A size goes to the packs that have the most room left, the shortest packs, as far as
    there are any with enough; packs of one pattern are one entry with a count, and an entry that is used in part is
    split. What finds no room opens new packs. Each size then adds at most one new entry for what is left and one for
    every entry it uses up or splits, so entries are few.
    """
    if any(s < 1 or s > capacity for s in histogram):
        raise ValueError("sizes must lie between 1 and the capacity")
    by_room: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, count]
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r, x in by_room.items() if x), default=0)
            if room < size:
                fits = capacity // size
                # New packs take the size as often as it fits: the next of its kind would find them the shortest.
                full, rest = divmod(left, fits)
                if full:
                    by_room[capacity - fits * size].append([(size,) * fits, full])
                if rest:
                    by_room[capacity - rest * size].append([(size,) * rest, 1])
                left = 0
                continue
            pattern, count = by_room[room].pop()
            used = min(count, left)
            if used < count:
                by_room[room].append([pattern, count - used])
            by_room[room - size].append([(*pattern, size), used])
            left -= used
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for entries in by_room.values():
        for pattern, count in entries:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Of each pattern and size `size, first_rank, next_rank, per_container, first_container, first_place`: the ranks
    from `first_rank` below `next_rank` of the size go there, `per_container` to each container."""
    out, ranks, base = [], defaultdict(int), 0
    for pattern, count in patterns:
        for size in sorted(set(pattern), reverse=True):
            per = pattern.count(size)
            out.append((size, ranks[size], ranks[size] + per * count, per, base, pattern.index(size)))
            ranks[size] += per * count
        base += count
    return out


def place_column(rows: list[tuple[int, int, int, int, int, int]]):
    """A column function of size and rank to `container, place`, by a binary search among the sorted ranges of `slots`: an
    item meets one range, however many patterns use its size. The table has at most as many rows as the patterns have
    sizes, which the capacity bounds."""
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    sizes, first = np.unique(table[:, 0], return_index=True)

    @F.pandas_udf(T.StructType([T.StructField("container", T.LongType()), T.StructField("place", T.IntegerType())]))
    def of(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        own, r = size.to_numpy(), rank.to_numpy()
        row = np.empty(len(own), np.int64)
        at = np.searchsorted(sizes, own)
        for k in np.unique(at):
            here = at == k
            low, high = first[k], first[k + 1] if k + 1 < len(first) else len(table)
            row[here] = low + np.searchsorted(table[low:high, 1], r[here], side="right") - 1
        beyond = r - table[row, 1]
        return pd.DataFrame({"container": table[row, 4] + beyond // table[row, 3], "place": (table[row, 5] + beyond % table[row, 3]).astype(np.int32)})

    return of


def split_pieces(sized: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """`key, piece, size, offset`: an item within the capacity is one piece; a larger one is cut into full pieces and
    what is left. An item of size 0 is one piece of size 0, one of unknown size (null) counts as that."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / F.lit(capacity)).cast("long") - 1, F.lit(0).cast("long"))
    each = sized.select(F.col(key), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return each.select(key, "piece", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * capacity).cast("int").alias("size"), (F.col("piece") * capacity).alias("offset"))


def ranked(pieces: DataFrame, histogram: DataFrame, *order: str) -> DataFrame:
    """`pieces` with `rank` from 0 within its size.

    A size with many items is numbered in parts of about PART_ROWS, each of which is then shifted by the counts of the
    parts before. The parts' counts are joined by the same keys by which the parts are already distributed.
    """
    parts = histogram.select("size", F.ceil(F.col("n") / F.lit(PART_ROWS)).alias("_parts"))
    parted = pieces.join(F.broadcast(parts), "size").withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    counts = parted.groupBy("size", "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shift = counts.select("size", "_part", (before - F.col("_c")).alias("_before"))
    inner = parted.withColumn("_in", F.row_number().over(Window.partitionBy("size", "_part").orderBy(*order)) - 1)
    return inner.join(shift, ["size", "_part"]).withColumn("rank", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def pack(sized: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """`container, key, piece, place, size, offset` of every piece.

    Containers are numbered from 0 without gaps, places within a container from 0 by falling size. Pieces of size 0
    need no room: their container and place are null. Nothing else has a null there, and no container holds more than
    `capacity`. Keys must be unique for a result that doesn't depend on the order of rows; repeated keys are items of
    their own all the same. An empty table gives an empty result.
    """
    spark = sized.sparkSession
    pieces = cut(split_pieces(sized, key, size, capacity))
    filled = pieces.where(F.col("size") > 0)
    counted = filled.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    histogram = spark.createDataFrame([(r["size"], r["n"]) for r in counted], "size int, n long")
    rows = slots(shortest_pack_first({r["size"]: r["n"] for r in counted}, capacity))
    at = place_column(rows)(F.col("size"), F.col("rank"))
    put = ranked(filled, histogram, key, "piece").select(at.alias("at"), key, "piece", "size", "offset").select("at.container", key, "piece", "at.place", "size", "offset")
    none = pieces.where(F.col("size") == 0).select(F.lit(None).cast("long").alias("container"), key, "piece", F.lit(None).cast("int").alias("place"), "size", "offset")
    return put.unionByName(none)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """`pack` of documents by their number of tokens."""
    return pack(count_tokens(docs, path=path), "doc_id", "n_tokens", capacity)
