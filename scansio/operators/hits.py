"""The verses that have most trigrams in common with transcripts.

Verses meet transcripts in a fixed number of tasks. A task keeps the best verses of each of its transcripts, so what is
shuffled is verses, transcripts, and of each transcript and task as many places as are asked for: not the pairs that have
a trigram in common, which grow with both tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scansio.session import written

#: Verses whose trigrams are counted together, and transcripts that a task holds at most, about.
BLOCK, HELD = 1 << 15, 1 << 14
#: A task sends so many times its share of the best, and so many more.
SENT, SENT_LEAST = 3, 8


def trigrams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of texts as numbers, in order, and the text that each stands in; repeated ones stay."""
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    whole = own[2:] == own[:-2]
    return (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[whole], own[2:][whole]


class Best:
    """The `k` best verses of each transcript: by hits, the place of the first of its trigrams that hits, and the order in
    which verses come."""

    def __init__(self, asked: list[str], k: int):
        self.k = k
        every = [np.fromiter(dict.fromkeys(t.tolist()), np.int64) for t in np.split(*self._cuts(asked))]
        self.ends = np.cumsum([len(t) for t in every])
        self.asked = np.concatenate([*every, np.zeros(0, np.int64)])
        self.keys = [np.zeros(0, np.int64)] * len(every)
        self.ats = [np.zeros(0, np.int64)] * len(every)

    @staticmethod
    def _cuts(asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tri, own = trigrams_of(asked)
        return tri, np.searchsorted(own, np.arange(1, len(asked)))

    def meet(self, texts: list[str], ats: np.ndarray) -> None:
        """Take on verses in their order, after those met before."""
        tri, own = trigrams_of(texts)
        if not len(tri) or not len(self.asked):
            return
        known, tri = np.unique(tri, return_inverse=True)
        posts = np.unique(tri * len(texts) + own)
        begins = np.searchsorted(posts, np.arange(len(known) + 1) * len(texts))
        posts %= len(texts)
        at = np.minimum(np.searchsorted(known, self.asked), len(known) - 1)
        there = known[at] == self.asked
        start, stop = np.where(there, begins[at], 0).tolist(), np.where(there, begins[at + 1], 0).tolist()
        first, low = np.zeros(len(texts), np.int64), 0
        for i, high in enumerate(self.ends.tolist()):
            met = [(pos, posts[a:b]) for pos, (a, b) in enumerate(zip(start[low:high], stop[low:high])) if b > a]
            low = high
            if not met:
                continue
            hits = np.bincount(np.concatenate([p for _, p in met]), minlength=len(texts))
            full = len(self.keys[i]) >= self.k
            some = np.flatnonzero(hits >= (-(self.keys[i][-1] >> 32) if full else 1))
            if not len(some):
                continue
            for pos, p in reversed(met):
                first[p] = pos
            keys = (-hits[some] << 32) + first[some]
            if full:  # of equals those that came before stay
                better = keys < self.keys[i][-1]
                keys, some = keys[better], some[better]
            if len(keys):
                if len(keys) > self.k:
                    most = np.partition(keys, self.k - 1)[self.k - 1]
                    keys, some = keys[keys <= most], some[keys <= most]
                keys, own_ats = np.concatenate([self.keys[i], keys]), np.concatenate([self.ats[i], ats[some]])
                order = np.argsort(keys, kind="stable")[: self.k]
                self.keys[i], self.ats[i] = keys[order], own_ats[order]


def most_common(prepared: DataFrame, verses: DataFrame, k: int) -> DataFrame:
    """`qid, at, hits, rank` (from 1) of the `k` best of `verses` (at, ns) for each transcript (qid, qns), where `at` tells
    the order of verses.

    Verses are spread over tasks by hash, so of the best a task has about as many as any other, and sends three times as
    many. Where the last that it sent is among the `k` best, there may be more: these transcripts are counted again, with
    all `k` of each task."""
    cores = prepared.sparkSession.sparkContext.defaultParallelism
    held = max(1, -(-prepared.count() // HELD))
    parts = max(1, -(-2 * cores // held))
    few = min(k, SENT * -(-k // parts) + SENT_LEAST)
    some = _counted(prepared, verses, k, few, held, parts)
    if few == k:
        return some.drop("last")
    some = written(some)
    short = some.where(F.col("last") & (F.col("rank") < k)).select("qid").distinct()
    if short.isEmpty():
        return some.drop("last")
    again = prepared.join(short, "qid", "left_semi")
    held = max(1, -(-again.count() // HELD))
    rest = _counted(again, verses, k, k, held, max(1, -(-2 * cores // held)))
    return some.join(short, "qid", "left_anti").unionByName(rest).drop("last")


def _counted(prepared: DataFrame, verses: DataFrame, k: int, few: int, held: int, parts: int) -> DataFrame:
    """`qid, at, hits, rank, last` of the `k` best of the `few` best of each task; `last`: it is the last of so many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked, texts, ats, best = [], [], [], [], None
        for pdf in batches:
            verse = pdf["at"].notna().to_numpy()
            if not verse.all():  # transcripts come first
                ids += pdf["qid"][~verse].astype("int64").tolist()
                asked += pdf["text"][~verse].tolist()
            if verse.any():
                texts += pdf["text"][verse].tolist()
                ats += pdf["at"][verse].astype("int64").tolist()
            if len(texts) >= BLOCK:
                best = best or Best(asked, few)
                best.meet(texts, np.array(ats))
                texts, ats = [], []
        if not asked:
            return
        best = best or Best(asked, few)
        best.meet(texts, np.array(ats, np.int64))
        for i in range(0, len(ids), 1000):
            yield pd.DataFrame({"qid": ids[i : i + 1000], "key": best.keys[i : i + 1000], "at": best.ats[i : i + 1000]})

    spark = prepared.sparkSession
    cores = spark.sparkContext.defaultParallelism
    of = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = prepared.select("qid", F.lit(None).cast("long").alias("at"), F.col("qns").alias("text"), of("qid", held).alias("held"), every(parts).alias("part"))
    read = verses.where(F.length("ns") >= 3).select(F.lit(None).cast("long").alias("qid"), "at", F.col("ns").alias("text"), every(held).alias("held"), of("at", parts).alias("part"))
    task = (F.col("held") * parts + F.col("part")).cast("int")
    both = asked.unionByName(read).withColumn("task", task).select("task", "qid", "at", "text").repartitionById(held * parts, F.col("task"))
    got = both.sortWithinPartitions(F.col("at").asc_nulls_first()).select("qid", "at", "text").mapInPandas(run, "qid long, key array<long>, at array<long>")
    together = got.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), "qid")
    each = together.select("qid", F.posexplode(F.arrays_zip("key", "at")).alias("pos", "e")).select("qid", "e.key", "e.at", (F.col("pos") == few - 1).alias("last"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("key", "at"))).where(F.col("rank") <= k)
    return ranked.select("qid", "at", (-F.shiftright("key", 32)).alias("hits"), "rank", "last")
