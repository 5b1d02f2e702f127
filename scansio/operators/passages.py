"""One book in memory: the matching of `scansio.operators.matching`, one transcript at a time."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from scansio.functions import distance as ds
from scansio.functions import score as sc
from scansio.operators.batches import Asked, Texts, alphabet
from scansio.operators.corpus import BONUSES, CONTEXT
from scansio.operators.matching import EPSILON, partials_of

#: Verses of the largest book that is held in memory.
MOST_VERSES = 20_000


@dataclass
class Verse:
    surah: int
    ayah: int
    text: str
    name: str
    norm: str
    ns: str
    no_bsm: str | None
    no_bsm_ns: str | None
    words: list[str]


@dataclass
class Answer:
    surah: int
    ayah: int
    ayah_end: int | None
    score: float
    norm: str
    runners: list[tuple[int, int, float]]


class PassageIndex:
    def __init__(self, verses: list[Verse]):
        if len(verses) > MOST_VERSES:
            raise ValueError(f"{len(verses)} verses; an index holds {MOST_VERSES} at most")
        self.verses = verses
        self.at = {(v.surah, v.ayah): i for i, v in enumerate(verses)}
        self.surahs: dict[int, list[int]] = defaultdict(list)
        posts: dict[str, list[int]] = defaultdict(list)
        for i, v in enumerate(verses):
            self.surahs[v.surah].append(i)
            for t in {v.ns[k : k + 3] for k in range(len(v.ns) - 2)}:
                posts[t].append(i)
        self.posts = {t: np.array(p) for t, p in posts.items()}
        norms, without = [v.norm for v in verses], [i for i, v in enumerate(verses) if v.no_bsm]
        self.chars = alphabet(norms)
        self.texts = Texts([*norms, *(verses[i].no_bsm for i in without)], self.chars)
        self.without = np.full(len(verses), -1)
        self.without[without] = len(verses) + np.arange(len(without))
        self.runs: dict[tuple[int, int], tuple[list[tuple[int, int, int]], list[str]]] = {}

    @staticmethod
    def of(corpus: DataFrame, book: str) -> PassageIndex:
        """The index of a book; it must be small enough to be held."""
        rows = corpus.where(corpus.book == book).orderBy("idx").limit(MOST_VERSES + 1).collect()
        return PassageIndex([Verse(r.surah, r.ayah, r.text_uthmani or "", r.surah_name or "", r.norm, r.ns, r.no_bsm, r.no_bsm_ns, list(r.words)) for r in rows])

    def next_of(self, surah: int, ayah: int) -> int | None:
        """The next ayah, or the first verse of the next surah."""
        i = self.at.get((surah, ayah + 1))
        return i if i is not None else next(iter(self.surahs.get(surah + 1, ())), None)

    def around(self, surah: int, ayah: int) -> list[tuple[int, int, str, bool]]:
        return [(v.surah, v.ayah, v.text, v.ayah == ayah) for v in (self.verses[i] for i in self.surahs.get(surah, ())) if abs(v.ayah - ayah) <= CONTEXT]

    def bonuses(self, hint: tuple[int, int] | None) -> dict[int, float]:
        if hint is None:
            return {}
        s, a = hint
        if (s, a + 1) in self.at:
            return {self.at[s, a + 1 + k]: b for k, b in enumerate(BONUSES) if (s, a + 1 + k) in self.at}
        return dict(zip(self.surahs.get(s + 1, ()), BONUSES))

    def candidates(self, ns: str, k: int) -> list[int]:
        """Verses by common trigrams, the place of the first of them in the text, and their own order; all verses for a
        text without trigrams."""
        if len(ns) < 3:
            return list(range(len(self.verses)))
        hits = np.zeros(len(self.verses), np.int64)
        first = np.full(len(self.verses), len(ns))
        for pos, t in enumerate(dict.fromkeys(ns[i : i + 3] for i in range(len(ns) - 2))):
            p = self.posts.get(t)
            if p is not None:
                hits[p] += 1
                first[p] = np.minimum(first[p], pos)
        some = np.nonzero(hits)[0]
        return some[np.lexsort((some, first[some], -hits[some]))[:k]].tolist()

    def raw_scores(self, norm: str, some: list[int], bonus: dict[int, float]) -> np.ndarray:
        """Of every verse the best of its component scores."""
        if Asked.fits(norm):
            vi = np.array(some, np.int64)
            likely = np.array([bonus.get(i, 0) > 0 for i in some], bool)
            return Asked([norm], self.chars).raw(self.texts, np.zeros(len(some), np.int64), vi, self.without[vi], likely, True)
        rows = [(self.verses[i].norm, self.verses[i].no_bsm) for i in some]
        return raw_scores_of(norm, rows, np.array([bonus.get(i, 0) > 0 for i in some], bool), True)

    def _runs(self, surah: int, span: int) -> tuple[list[tuple[int, int, int]], list[str]]:
        """`start, ayah_end, first` and text of the runs of a surah, in the order of start and length."""
        if (surah, span) not in self.runs:
            own, refs, texts = self.surahs[surah], [], []
            for k in range(len(own)):
                for n in range(2, span + 1):
                    if k + n <= len(own):
                        v = [self.verses[i] for i in own[k : k + n]]
                        refs.append((own[k], v[-1].ayah, v[0].ayah))
                        texts.append(" ".join([v[0].no_bsm if v[0].no_bsm is not None else v[0].norm, *(x.norm for x in v[1:])]))
            self.runs[surah, span] = refs, texts
        return self.runs[surah, span]

    def match(self, norm: str, threshold: float = 0.3, span: int = 3, hint: tuple[int, int] | None = None, top: int = 0, k: int = 200, groups: int = 20) -> Answer | None:
        """The best verse or run for a normalised transcript, with the `top` best single verses beside it."""
        ns = norm.replace(" ", "")
        if len(ns) < 3:
            return None
        bonus = self.bonuses(hint)
        some = list(dict.fromkeys([*self.candidates(ns, k), *bonus]))
        if not some:
            return None
        raw = self.raw_scores(norm, some, bonus)
        total = np.minimum(raw + np.array([bonus.get(i, 0.0) for i in some]), 1.0)
        near = total > total.max() - EPSILON
        diff = np.array([abs(len(self.verses[i].ns) - len(ns)) for i in some])
        order = sorted(range(len(some)), key=lambda j: (not near[j], diff[j] if near[j] else 0, -total[j], diff[j], j))
        best = self.verses[some[order[0]]]
        score, end, text, at = float(total[order[0]]), None, best.norm, (best.surah, best.ayah)
        refs, texts, tried = [], [], []
        for s in dict.fromkeys(self.verses[some[j]].surah for j in order[:groups]):
            for r, t in zip(*self._runs(s, span)):
                # No text is more like another than their lengths allow.
                bound = 2 * min(len(t), len(norm)) / (len(t) + len(norm)) + bonus.get(r[0], 0.0)
                if bound > score:
                    refs.append((s, *r))
                    texts.append(t)
                    tried.append(bonus.get(r[0], 0.0))
        if texts:
            got = np.minimum(ds.ratios(norm, texts) + np.array(tried), 1.0)
            j = int(got.argmax())
            if got[j] > score:
                score, end, text, at = float(got[j]), refs[j][2], texts[j], (refs[j][0], refs[j][3])
        if score < threshold:
            return None
        return Answer(*at, end, score, text, [self._runner(some[j], total[j]) for j in order[: max(top, 5)]][:top])

    def _runner(self, i: int, total: float) -> tuple[int, int, float]:
        return self.verses[i].surah, self.verses[i].ayah, int(total * 1000 + 0.5) / 1000

    def narrow(self, norm: str, hint: tuple[int, int], ahead: int = 5, threshold: float = 0.35) -> Answer | None:
        """The best of the hinted verse, those ahead (into the next surahs) and the two before in its surah; if none
        reaches the threshold, what `match` finds."""
        some: list[int] = [self.at[hint]] if hint in self.at else []
        ref = hint
        for _ in range(ahead):
            i = self.next_of(*ref)
            if i is None:
                break
            some.append(i)
            ref = self.verses[i].surah, self.verses[i].ayah
        some += [i for i in self.surahs.get(hint[0], ()) if hint[1] - 2 <= self.verses[i].ayah < hint[1] and i not in some]
        if some and norm:
            bonus = self.bonuses(hint)
            total = np.minimum(self.raw_scores(norm, some, bonus) + np.array([bonus.get(i, 0.0) for i in some]), 1.0)
            order = np.argsort(-total, kind="stable").tolist()
            if total[order[0]] >= threshold:
                v = self.verses[some[order[0]]]
                return Answer(v.surah, v.ayah, None, float(total[order[0]]), v.norm, [self._runner(some[j], total[j]) for j in order[:10]])
        return self.match(norm, threshold, 3, hint, 10)


def raw_scores_of(norm: str, verses: list[tuple[str, str | None]], likely: np.ndarray, partial: bool) -> np.ndarray:
    """Of a transcript of any length and verses (norm, no_bsm) the best of the component scores; `likely` ones have a bonus."""
    ns, q = norm.replace(" ", ""), norm.split(" ")
    bare = [(v.replace(" ", ""), w and w.replace(" ", "")) for v, w in verses]
    frag, frag_nb, window, window_nb, sliding = partials_of(norm, ns, [(v.split(" "), a, w, b) for (v, w), (a, b) in zip(verses, bare)], partial).T
    best = np.maximum(0.95 * np.maximum(window, window_nb), 0.92 * sliding)

    def smart(texts: list[str | None], fragments: np.ndarray) -> None:
        there = [i for i, t in enumerate(texts) if t]
        own = [texts[i] for i in there]
        r, f = ds.ratios(ns, own), fragments[there]
        short = len(ns) / np.array([len(t) for t in own] or [1.0]) < 0.7
        best[there] = np.maximum(best[there], np.where(short[: len(own)], np.maximum(f, 0.6 * f + 0.4 * r), r))

    def plain(texts: list[str | None]) -> None:
        there = [i for i, t in enumerate(texts) if t is not None]
        best[there] = np.maximum(best[there], ds.ratios(norm, [texts[i] for i in there]))

    smart([a for a, _ in bare], frag)
    smart([b for _, b in bare], frag_nb)
    plain([v for v, _ in verses])
    plain([w for _, w in verses])
    for j in np.flatnonzero(likely).tolist():
        best[j] = max(best[j], _suffix(q, verses[j][0].split(" ")))
    return best


def _suffix(q: list[str], words: list[str]) -> float:
    if len(q) < 2 or len(words) < 2:
        return 0.0
    return max(sc.ratio_of(" ".join(q[k:]), " ".join(words[: len(q) - k])) for k in range(1, min(len(q) // 2, 4) + 1))
