"""The verses that hints make likely, in every book, without a table of them.

Transcripts with a hint meet the verses of whole books in a fixed number of tasks. A task scores the verses that a hint makes
likely and keeps of each transcript only those that may be among the best, so that what is shuffled is verses, transcripts
and a few rows of each transcript and task: not transcripts times books.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.operators import batches
from scansio.operators.corpus import BONUSES

#: Verses that are looked at together, at least, by whole books; transcripts that a task holds at most, about; pairs that
#: are scored together, about.
BLOCK, HELD, PAIRS = 1 << 13, 1 << 14, 1 << 15
EPSILON = 0.001
#: No word window or sliding run scores more.
WINDOWED = 0.95


class Block:
    """Verses of whole books in their order."""

    def __init__(self, rows: pd.DataFrame, chars: np.ndarray):
        norm, without = rows["norm"].tolist(), rows["no_bsm"].tolist()
        some = [i for i, x in enumerate(without) if x]
        self.at = rows["at"].to_numpy(np.int64)
        self.texts = batches.Texts([*norm, *(without[i] for i in some)], chars)
        self.without = np.full(len(norm), -1)
        self.without[some] = len(norm) + np.arange(len(some))
        self.norm, self.no_bsm = norm, without
        self.book = np.unique(self.at >> 32, return_inverse=True)[1]
        self.surah, self.ayah = rows["surah"].to_numpy(np.int64), rows["ayah"].to_numpy(np.int64)
        new = np.ones(len(norm), bool)
        new[1:] = (np.diff(self.book) != 0) | (np.diff(self.surah) != 0)
        nth = np.arange(len(norm)) - np.maximum.accumulate(np.where(new, np.arange(len(norm)), 0))
        self.by_ref, self.by_nth = self._index(self.ayah), self._index(nth)

    def _index(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.surah << 32 | (number & 0xFFFFFFFF)
        order = np.argsort(key, kind="stable")
        return key[order], order

    @staticmethod
    def _of(index: tuple[np.ndarray, np.ndarray], surah: int, number: int) -> np.ndarray:
        low, high = np.searchsorted(index[0], [key := surah << 32 | (number & 0xFFFFFFFF), key + 1])
        return index[1][low:high]

    def bonuses(self, hint: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The verses that `corpus.continuation_bonuses` names for a hint, and their bonuses."""
        surah, ayah = hint
        first = self._of(self.by_ref, surah, ayah + 1)
        has = np.zeros(self.book[-1] + 1, bool)
        has[self.book[first]] = True
        each = []
        for i in range(len(BONUSES)):
            within, rolled = self._of(self.by_ref, surah, ayah + 1 + i), self._of(self.by_nth, surah + 1, i)
            each.append(np.concatenate([within[has[self.book[within]]], rolled[~has[self.book[rolled]]]]))
        return np.concatenate(each), np.repeat(BONUSES, [len(x) for x in each])

    def near(self, hint: tuple[int, int], ahead: int, behind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The verses near a hint, their ranks and their bonuses, as `matching.match_near` has them."""
        at = self._of(self.by_ref, *hint)
        step = np.concatenate([np.arange(ahead + 1), np.arange(-behind, 0)])
        rank = np.concatenate([np.arange(ahead + 1), ahead + 1 + np.arange(behind)])
        rows, rank = (at[:, None] + step).ravel(), np.tile(rank, len(at))
        of = np.repeat(at, len(step))
        there = (rows >= 0) & (rows < len(self.at))
        rows, rank, of = rows[there], rank[there], of[there]
        there = (self.at[rows] - self.at[of] == rows - of) & ((rows >= of) | (self.surah[rows] == hint[0]))
        rows, rank = rows[there], rank[there]
        bonus = np.zeros(len(self.at))
        likely, b = self.bonuses(hint)
        bonus[likely] = b
        return rows, rank, bonus[rows]


class Best:
    """What is kept of a transcript's verses: rows `at, total, diff, rank, bonus`. `k` best: all that may be among the `k`
    first in the order of `matching.ranked`, whatever other verses there are. With `near` the first by total and rank."""

    def __init__(self, asked: list[str], k: int, near: bool):
        self.k, self.near = (1, True) if near else (k, False)
        self.rows = [np.zeros((0, 5)) for _ in asked]
        self.fits = np.array([batches.Asked.fits(q) for q in asked], bool)
        self.text = asked
        self.chars = batches.alphabet(asked)
        self.asked = batches.Asked([q if f else "" for q, f in zip(asked, self.fits)], self.chars)
        self.size = np.array([len(q.replace(" ", "")) for q in asked], np.int64)
        # Least total of what is kept for sure, and the greatest difference (or rank) that is still of use at that total.
        self.least, self.reach = np.full(len(asked), -1.0), np.full(len(asked), np.inf)
        self.place = np.full(len(asked), np.inf)

    def meet(self, block: Block, pairs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], partial: bool) -> None:
        """Take on pairs: of each transcript the verses of a block, ranks and bonuses. The likeliest are scored first."""
        qi = np.repeat([p[0] for p in pairs], [len(p[1]) for p in pairs])
        vi, rank, bonus = (np.concatenate([p[i] for p in pairs]) for i in (1, 2, 3))
        for own in (bonus == BONUSES[0], (bonus > 0) & (bonus < BONUSES[0]), bonus == 0):
            if own.any():
                self._meet(block, qi[own], vi[own], rank[own], bonus[own], partial)

    def _useful(self, qi: np.ndarray, most: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which pairs whose total is at most `most` may still be kept: `second` is the difference or the rank."""
        if self.near:
            return (most > self.least[qi]) | ((most == self.least[qi]) & ((second < self.reach[qi]) | ((second == self.reach[qi]) & (at < self.place[qi]))))
        return (most > self.least[qi]) | (second <= self.reach[qi]) & (most >= self.least[qi] - EPSILON)

    def _meet(self, block: Block, qi: np.ndarray, vi: np.ndarray, rank: np.ndarray, bonus: np.ndarray, partial: bool) -> None:
        diff = np.abs(block.texts.ns_size[vi] - self.size[qi])
        second = rank if self.near else diff
        some = self._useful(qi, np.ones(len(qi)), second, block.at[vi])
        qi, vi, rank, bonus, diff, second = (x[some] for x in (qi, vi, rank, bonus, diff, second))
        fit = self.fits[qi]
        if not self.fits.all():
            raw = np.zeros(len(qi))
            raw[~fit] = self._long(block, qi[~fit], vi[~fit], bonus[~fit], partial)
        # Nothing but a fragment or a ratio is above what windows reach, and neither is above the share of characters that stay.
        if not bonus.any() and len(qi):
            m, n = self.asked.qns.size[qi], block.texts.ns_size[vi]
            bound = np.ones(len(qi))
            may = np.flatnonzero(fit & (WINDOWED <= self.least[qi]) & (block.without[vi] < 0) & (n > 0))
            d = batches.least(self.asked.qns, qi[may], block.texts, vi[may])
            bound[may] = np.maximum(WINDOWED, np.where(d == 0, 1.0, 1 - d / (2 * self.asked.q.size[qi[may]] + d) + 1e-9))
            some = self._useful(qi, bound, second, block.at[vi])
            if not self.fits.all():
                raw = raw[some]
            qi, vi, rank, bonus, diff, second, fit = (x[some] for x in (qi, vi, rank, bonus, diff, second, fit))
        got = self.asked.raw(block.texts, qi[fit], vi[fit], block.without[vi[fit]], bonus[fit] > 0, partial)
        if self.fits.all():
            raw = got
        else:
            raw[fit] = got
        total = np.minimum(raw + bonus, 1.0)
        some = self._useful(qi, total, second, block.at[vi])
        rows = np.stack([block.at[vi], total, diff, rank, bonus], axis=1)[some]
        qi = qi[some]
        cuts = np.flatnonzero(np.diff(qi)) + 1
        for i, own in zip(qi[np.concatenate([[0], cuts])].tolist() if len(qi) else [], np.split(rows, cuts)):
            self._keep(i, own)

    def _long(self, block: Block, qi: np.ndarray, vi: np.ndarray, bonus: np.ndarray, partial: bool) -> np.ndarray:
        from scansio.operators.passages import raw_scores_of

        out = np.zeros(len(qi))
        for i in np.unique(qi).tolist():
            own = np.flatnonzero(qi == i)
            out[own] = raw_scores_of(self.text[i], [(block.norm[v], block.no_bsm[v]) for v in vi[own].tolist()], bonus[own] > 0, partial)
        return out

    def _keep(self, i: int, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows[i], rows])
        if self.near:
            order = np.lexsort((rows[:, 0], rows[:, 3], -rows[:, 1]))[:1]
            self.rows[i] = rows[order]
            self.place[i], self.least[i], _, self.reach[i], _ = rows[order[0]]
            return
        rows = rows[np.lexsort((rows[:, 0], rows[:, 2], -rows[:, 1]))]
        if len(rows) > self.k:
            low = rows[self.k - 1, 1]
            # What is further below than EPSILON is never near the greatest; what is near may come first by its difference,
            # unless as many that score no less are no further in length.
            rows = rows[rows[:, 1] >= min(low, rows[0, 1] - EPSILON)]
            kept, first = list(range(min(self.k, len(rows)))), np.sort(rows[: self.k, 2])
            for j in range(self.k, len(rows)):
                if rows[j, 2] < first[-1]:
                    kept.append(j)
                    first = np.sort(np.append(first, rows[j, 2]))[: self.k]
            rows = rows[kept]
            self.least[i] = low
            self.reach[i] = np.sort(rows[rows[:, 1] >= low, 2])[self.k - 1]
        self.rows[i] = rows


def _met(prepared: DataFrame, verses: DataFrame, run) -> DataFrame:
    spark = prepared.sparkSession
    hinted = prepared.where("hint_surah IS NOT NULL AND hint_ayah IS NOT NULL")
    held = max(1, -(-hinted.count() // HELD))
    # Few tasks with many books each: what was found in the first books tells what needn't be scored in the others.
    parts = max(1, -(-2 * spark.sparkContext.defaultParallelism // held))
    of = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    null = lambda kind: F.lit(None).cast(kind)
    asked = hinted.select("qid", null("long").alias("at"), F.col("hint_surah").cast("long").alias("surah"), F.col("hint_ayah").cast("long").alias("ayah"), F.col("q").alias("norm"), null("string").alias("no_bsm"), of("qid", held).alias("held"), every(parts).alias("part"))
    read = verses.select(null("long").alias("qid"), "at", F.col("surah").cast("long").alias("surah"), F.col("ayah").cast("long").alias("ayah"), "norm", "no_bsm", every(held).alias("held"), of("book", parts).alias("part"))
    both = asked.unionByName(read).withColumn("task", (F.col("held") * parts + F.col("part")).cast("int")).drop("held", "part").repartitionById(held * parts, F.col("task"))
    got = both.sortWithinPartitions(F.col("at").asc_nulls_first()).drop("task").mapInPandas(run, "qid long, e array<struct<at:long,total:double,diff:long,rank:int,bonus:double>>")
    return got.select("qid", F.explode("e").alias("e")).select("qid", "e.*")


def _task(pairs_of, k: int, near: bool, partial: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked, hints, verses, held, best, by_hint = [], [], [], [], 0, None, {}

        def take(rows: pd.DataFrame) -> None:
            nonlocal best
            if best is None:
                best = Best(asked, k, near)
                for i, h in enumerate(hints):
                    by_hint.setdefault(h, []).append(i)
            block, pairs, n = Block(rows, best.chars), [], 0
            for h, own in by_hint.items():
                found = pairs_of(block, h)
                for i in own if len(found[0]) else ():
                    pairs.append((i, *found))
                    n += len(found[0])
                    if n >= PAIRS:
                        best.meet(block, pairs, partial)
                        pairs, n = [], 0
            if pairs:
                best.meet(block, pairs, partial)

        for pdf in frames:
            verse = pdf["at"].notna().to_numpy()
            if not verse.all():  # transcripts come first
                own = pdf[~verse]
                ids += own["qid"].astype("int64").tolist()
                asked += own["norm"].tolist()
                hints += zip(own["surah"].tolist(), own["ayah"].tolist())
            if verse.any() and asked:
                verses.append(pdf[verse])
                held += len(verses[-1])
            if held >= 2 * BLOCK:
                rows = pd.concat(verses, ignore_index=True)
                book = rows["at"].to_numpy(np.int64) >> 32
                low = 0
                starts = np.flatnonzero(np.diff(book)) + 1
                for high in starts.tolist():
                    if high - low >= BLOCK:
                        take(rows.iloc[low:high])
                        low = high
                verses, held = [rows.iloc[low:]], len(rows) - low
        if held:
            take(pd.concat(verses, ignore_index=True))
        if best is None:
            return
        for i in range(0, len(ids), 1000):
            rows = best.rows[i : i + 1000]
            yield pd.DataFrame({"qid": ids[i : i + 1000], "e": [[(int(a), t, int(d), int(r), b) for a, t, d, r, b in x.tolist()] for x in rows]})

    return run


def likely(prepared: DataFrame, verses: DataFrame, k: int, partial: bool) -> DataFrame:
    """`qid, at, bonus, total, diff` of the verses of every book that a hint of `prepared` (qid, q, hint_surah, hint_ayah) gives a bonus, of
    each transcript those that may be among its `k` best."""
    none = lambda found: (found[0], np.zeros(len(found[0]), np.int64), found[1])
    return _met(prepared, verses, _task(lambda block, hint: none(block.bonuses(hint)), k, False, partial))


def nearest(prepared: DataFrame, verses: DataFrame, ahead: int, behind: int, partial: bool) -> DataFrame:
    """`qid, at, bonus, total, rank`: of each transcript the best verses near its hint, one a task."""
    return _met(prepared, verses, _task(lambda block, hint: block.near(hint, ahead, behind), 1, True, partial))
