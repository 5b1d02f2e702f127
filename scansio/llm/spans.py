"""Long exact spans shared between records: every stretch of a value that occurs verbatim in another record.

Suffix automata of bounded shards of reference text give, for every place of a document, the longest text ending there
that also stands in another record (matching statistics); what reaches the least length is shared. To send every
document past every shard would compare all text with all text, so documents meet the shards where they can match:

1. Anchors. Of every `w` neighbouring `k`-grams the one with the least hash is picked, with k + w - 1 = least length. Two
   records that share a stretch of the least length share a whole window and thereby its anchor.
2. An anchor that more than one record holds is shared. Counting needs one row per anchor and task, however common it is.
   Each anchor carries a signature of the set of its records; anchors of one signature need to meet only once.
3. The regions of text around shared anchors are sent to the signature's place. Copies are combined before that: of a
   region's text that many records hold, one row with the least and greatest of its owners travels, and its places are
   joined back at the end. There shards of about `shard_chars` are filled with whole signatures, an automaton is built
   over each, and its documents stream through it. A signature with more text than a shard is cut into several automata,
   one after another; no task ever holds more than `group_chars` of one.
4. A signature with more distinct text than `group_chars` is told apart further, by grams as long as the least length
   itself: every such stretch is a place of its own, where by then all text is the same and copies are one row.

Matches are exact; anchors only decide who meets whom.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scansio.session import cut

#: Least lengths in code points of the queries' fields.
FIELDS = {"text_norm": 60, "text_uthmani": 100}
#: Characters in one automaton, and of distinct regions that meet in one task.
SHARD_CHARS = 100_000
GROUP_CHARS = 400_000

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def _gram(least: int) -> int:
    return max(1, least // 2)


def _slide(values: np.ndarray, w: int, fold) -> np.ndarray:
    """`fold` over every `w` neighbours; the result has len - w + 1 values."""
    span = 1
    while span * 2 <= w:
        values = fold(values[:-span], values[span:])
        span *= 2
    return fold(values[: len(values) - (w - span)], values[w - span :]) if w > span else values


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(33))) | np.uint64(1)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every `k` neighbouring codes."""
    n = len(codes)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.cumprod(up), out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * np.cumprod(down)[: n - k + 1])


def anchors(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`row, place, hash` of the anchors of texts, each at least `least` long."""
    k = _gram(least)
    w = least - k + 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in texts])
    ends = np.cumsum(lens)
    h = gram_hashes(codes, k)
    row = np.repeat(np.arange(len(texts)), lens)
    place = np.arange(len(codes)) - np.repeat(ends - lens, lens)
    whole = place <= np.repeat(lens, lens) - least  # windows within their text begin here
    m = _slide(h, w, np.minimum)
    m = np.where(whole[: len(m)], m, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(len(h) - len(m), np.uint64)])
    picked = np.nonzero(_slide(padded, w, np.maximum) == h)[0]
    return row[picked], place[picked], h[picked].view(np.int64)


def _anchor_column(least: int):
    @F.pandas_udf("array<bigint>")
    def of(values: pd.Series) -> pd.Series:
        out = np.empty(len(values), object)
        out[:] = [[]] * len(values)
        long = [i for i, t in enumerate(values) if t is not None and len(t) >= least]
        if long:
            row, _, h = anchors([values[i] for i in long], least)
            pairs = np.unique(np.stack([row, h]), axis=1)
            cut = np.searchsorted(pairs[0], np.arange(len(long) + 1))
            for j, i in enumerate(long):
                out[i] = pairs[1, cut[j] : cut[j + 1]]
        return pd.Series(out)

    return of


class Automaton:
    """A suffix automaton of several texts, each with the least and greatest of its owners.

    `low` and `high` are the least and greatest owner of the places where a state's texts occur; `mixed` is the next
    state on the way up that has more than one owner (0 if there is none).
    """

    def __init__(self, texts: list[tuple[str, int, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        ends: list[int] = []
        lows: list[int] = []
        highs: list[int] = []
        for text, low, high in texts:
            last = 0
            for c in text:
                last = self._extend(last, c)
                ends.append(last)
            lows += [low] * len(text)
            highs += [high] * len(text)
        n = len(self.len)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, ends, lows)
        np.maximum.at(high, ends, highs)
        low, high, link = low.tolist(), high.tolist(), self.link
        order = np.argsort(self.len, kind="stable").tolist()
        for v in reversed(order):
            p = link[v]
            if p > 0:
                if low[v] < low[p]:
                    low[p] = low[v]
                if high[v] > high[p]:
                    high[p] = high[v]
        mixed = [0] * n
        for v in order:
            if v:
                mixed[v] = v if low[v] != high[v] else mixed[link[v]]
        self.low, self.mixed = low, mixed

    def _extend(self, last: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def shared(self, text: str, owner: int, least: int) -> list[tuple[int, int]]:
        """Runs `start, end` of `text` covered by stretches of at least `least` that another owner's texts hold."""
        nxt, link, length, low, mixed = self.next, self.link, self.len, self.low, self.mixed
        out: list[tuple[int, int]] = []
        v = size = 0
        for i, c in enumerate(text, 1):
            q = nxt[v].get(c)
            while q is None and v:
                v = link[v]
                size = length[v]
                q = nxt[v].get(c)
            if q is None:
                size = 0
                continue
            v, size = q, size + 1
            if size < least:
                continue
            if mixed[v] == v or low[v] != owner:
                n = size
            else:
                n = length[mixed[v]]
            if n >= least:
                if out and i - n <= out[-1][1]:
                    out[-1] = (min(out[-1][0], i - n), i)
                    while len(out) > 1 and out[-1][0] <= out[-2][1]:
                        s, _ = out.pop()
                        out[-1] = (min(out[-1][0], s), i)
                else:
                    out.append((i - n, i))
        return out


def _shards(regions: list[tuple[str, int, int]], chars: int) -> Iterator[list[tuple[str, int, int]]]:
    some: list[tuple[str, int, int]] = []
    size = 0
    for r in regions:
        if some and size + len(r[0]) > chars:
            yield some
            some, size = [], 0
        some.append(r)
        size += len(r[0])
    if some:
        yield some


def covered(texts: list[tuple[str, int, int]], least: int, shard_chars: int = SHARD_CHARS) -> list[list[tuple[int, int]]]:
    """Of each of some distinct texts, with their least and greatest owner, the runs `start, end` that another owner's
    texts hold as well. Where several owners hold a text, any of them has another beside it."""
    runs: list[list[tuple[int, int]]] = [[] if low == high else [(0, len(text))] for text, low, high in texts]
    for shard in _shards(texts, shard_chars):
        automaton = Automaton(shard)
        for own, (text, low, high) in zip(runs, texts):
            if low == high:
                own += automaton.shared(text, low, least)
    return runs


def _pieces(text: str, places: list[int], least: int, longest: int) -> Iterator[tuple[int, str]]:
    """`offset, text` of what lies around anchors: every stretch of `least` that contains one of them is in a region.
    Longer regions are cut so that no such stretch is lost."""
    reach, k = least - _gram(least), _gram(least)
    runs: list[list[int]] = []
    for p in sorted(places):
        s, e = max(0, p - reach), min(len(text), p + k + reach)
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        while e - s > longest:
            yield s, text[s : s + longest]
            s += longest - least + 1
        yield s, text[s:e]


def regions_of(df: DataFrame, key: str, fields: dict[str, int], longest: int = SHARD_CHARS // 4) -> DataFrame:
    """`_f, _sig, _id, _at, _text`: the regions around shared anchors of every record, each by the signature under which
    it meets those that may share a stretch with it."""
    names = list(fields)
    records = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), *[F.when(F.length(f) >= fields[f], F.col(f)).alias(f) for f in names])
    listed = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f"_a{i}").alias("_h")) for i in range(len(names))])
    # Redelivered rows are resolved first: a record that came twice would cancel out of the signatures.
    texts = records.where(F.coalesce(*names).isNotNull()).groupBy("_id").agg(F.max(F.struct(*names)).alias("_t"))
    hashed = texts.select("_id", *[_anchor_column(fields[f])(f"_t.{f}").alias(f"_a{i}") for i, f in enumerate(names)])
    held = hashed.select("_id", F.explode(listed).alias("_l")).select("_id", "_l._f", F.explode("_l._h").alias("_h"))
    met = held.groupBy("_f", "_h").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.bit_xor(F.xxhash64("_id", "_f")).alias("_sig"))
    met = met.where(F.col("_lo") != F.col("_hi")).select("_f", "_h", "_sig")
    by_record = held.join(met, ["_f", "_h"]).groupBy("_id").agg(F.collect_list(F.struct("_f", "_h", "_sig")).alias("_met"))
    suspects = texts.join(by_record, "_id").select("_id", "_met", *[F.col(f"_t.{f}").alias(f"_t{i}") for i, f in enumerate(names)])
    leasts = [fields[f] for f in names]

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, least in enumerate(leasts):
                where = [(o, t, m) for o, t, m in zip(pdf["_id"], pdf[f"_t{i}"], pdf["_met"]) if t is not None and any(x["_f"] == i for x in m)]
                if not where:
                    continue
                rows, places, hashes = anchors([t for _, t, _ in where], least)
                cut = np.searchsorted(rows, np.arange(len(where) + 1))
                for j, (owner, text, met_here) in enumerate(where):
                    about = {x["_h"]: x["_sig"] for x in met_here if x["_f"] == i}
                    by_sig: dict[int, list[int]] = {}
                    for p, h in zip(places[cut[j] : cut[j + 1]].tolist(), hashes[cut[j] : cut[j + 1]].tolist()):
                        if h in about:
                            by_sig.setdefault(about[h], []).append(p)
                    for sig, at in by_sig.items():
                        out += [(i, sig, owner, offset, piece) for offset, piece in _pieces(text, at, least, max(4 * least, longest))]
            for at in range(0, len(out), 10_000):
                yield pd.DataFrame(out[at : at + 10_000], columns=["_f", "_sig", "_id", "_at", "_text"])

    return suspects.mapInPandas(regions, "_f int, _sig long, _id long, _at int, _text string")


def distinct_regions(found: DataFrame) -> DataFrame:
    """`_f, _sig, _text, _lo, _hi, _d` of regions' distinct texts with their least and greatest owner: copies are combined
    in each task before they are shuffled."""
    met = found.groupBy("_f", "_sig", "_text").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    return met.withColumn("_d", _digest("_text"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def shared_spans(df: DataFrame, key: str, fields: dict[str, int], shard_chars: int = SHARD_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """`field, key, span_start, span_len` of every maximal run of shared characters of a value.

    A character is shared if it lies in a stretch of at least `fields[field]` code points that occurs, code point for
    code point, in the same field of another `key` (a 64-bit integer). Rows of one key are one record, whose anchors
    count once however often it was delivered; if its values differ, the greatest by Spark's ordering counts. Null,
    empty and short values have no shared characters.
    """
    names, leasts = list(fields), list(fields.values())
    # Regions are needed twice, to be matched and for their places; they are a part of the shared text.
    found = cut(regions_of(df, key, fields, shard_chars // 4))
    distinct = distinct_regions(found)
    large = distinct.groupBy("_f", "_sig").agg(F.sum(F.length("_text")).alias("_c")).where(F.col("_c") > group_chars).select("_f", "_sig")
    runs = _by_automata(distinct.join(large, ["_f", "_sig"], "left_anti"), leasts, shard_chars).unionByName(_by_stretch(distinct.join(large, ["_f", "_sig"], "left_semi"), leasts))
    places = found.select("_f", "_sig", "_id", "_at", _digest("_text").alias("_d"))
    covers = places.join(runs, ["_f", "_sig", "_d"]).select("_f", "_id", (F.col("_at") + F.col("_s")).alias("_s"), (F.col("_at") + F.col("_e")).alias("_e"))
    return _runs(covers, key, names)


_RUNS = "_f int, _sig long, _d binary, _s int, _e int"


def _by_automata(distinct: DataFrame, leasts: list[int], shard_chars: int) -> DataFrame:
    """`_f, _sig, _d, _s, _e` of shared runs of region texts, by automata over the texts that meet."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple[str, int, int]] = []
        names: list[tuple[int, bytes]] = []
        last, size = None, 0

        def flush() -> pd.DataFrame:
            got = covered(group, leasts[last[0]], shard_chars)
            return pd.DataFrame([(last[0], *name, *run) for name, runs in zip(names, got) for run in runs], columns=["_f", "_sig", "_d", "_s", "_e"])

        for pdf in batches:
            for f, sig, d, low, high, text in zip(pdf["_f"], pdf["_sig"], pdf["_d"], pdf["_lo"], pdf["_hi"], pdf["_text"]):
                if last and (f != last[0] or (size > shard_chars // 2 and sig != last[1])):
                    yield flush()
                    group, names, size = [], [], 0
                last = (f, sig)
                group.append((text, low, high))
                names.append((sig, d))
                size += len(text)
        if last:
            yield flush()

    there = distinct.repartition("_f", "_sig").sortWithinPartitions("_f", "_sig")
    return there.select("_f", "_sig", "_d", "_lo", "_hi", "_text").mapInPandas(match, _RUNS)


def _by_stretch(distinct: DataFrame, leasts: list[int]) -> DataFrame:
    """The same of texts of which too many meet: each of their stretches of the least length is a place of its own, named
    by a 128-bit digest; a place that two owners come to is shared."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, sig, d, low, high, text in zip(*(c.to_pylist() for c in batch.columns)):
                n = leasts[f]
                grams = [hashlib.blake2b(text[i : i + n].encode(), digest_size=16).digest() for i in range(len(text) - n + 1)]
                m = len(grams)
                if m:
                    columns = [pa.array(np.full(m, f, np.int32)), pa.array(np.full(m, sig, np.int64)), pa.array([d] * m, pa.binary()), pa.array(np.arange(m, dtype=np.int32))]
                    columns += [pa.array(np.full(m, low, np.int64)), pa.array(np.full(m, high, np.int64)), pa.array(grams, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["_f", "_sig", "_d", "_s", "_lo", "_hi", "_g"])

    each = distinct.select("_f", "_sig", "_d", "_lo", "_hi", "_text").mapInArrow(stretches, "_f int, _sig long, _d binary, _s int, _lo long, _hi long, _g binary")
    several = each.groupBy("_f", "_g").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("_f", "_g")
    least = F.element_at(F.array(*[F.lit(n) for n in leasts]), F.col("_f") + 1)
    return each.join(several, ["_f", "_g"]).select("_f", "_sig", "_d", "_s", (F.col("_s") + least).alias("_e"))


def _runs(covers: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Maximal runs of what overlaps or touches."""
    order = Window.partitionBy("_f", "_id").orderBy("_s", "_e")
    before = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = covers.withColumn("_new", F.when(before >= F.col("_s"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = apart.groupBy("_f", "_id", "_run").agg(F.min("_s").alias("span_start"), F.max("_e").alias("_e"))
    field = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_f") + 1)
    return runs.select(field.alias("field"), F.col("_id").alias(key), "span_start", (F.col("_e") - F.col("span_start")).alias("span_len"))


def shared_totals(df: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """`field, key, shared_chars, n_chars` of every record with a value: how many of its characters are shared."""
    spans = shared_spans(df, key, fields).groupBy("field", key).agg(F.sum("span_len").alias("shared_chars"))
    values = None
    for f in fields:
        one = df.where(F.col(key).isNotNull() & F.col(f).isNotNull()).groupBy(key).agg(F.max(F.length(f)).alias("n_chars")).select(F.lit(f).alias("field"), key, "n_chars")
        values = one if values is None else values.unionByName(one)
    return values.join(spans, ["field", key], "left").select("field", key, F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), "n_chars")
