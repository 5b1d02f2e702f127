"""Scores of many pairs of transcripts and verses at once: `matching.partials_of` and the rest of a pair's scores.

Every pair, or word or run of words of a pair, is a column with a pattern of its own, at most 64 characters; one step takes
all columns on by a character. Texts are encoded once, whatever the number of pairs they are in.
"""

from __future__ import annotations

import numpy as np

from scansio.functions import score as sc

#: Columns that are taken on together: their arrays stay in a core's cache.
COLUMNS = 1 << 13
_ONE = np.uint64(1)
_TOP = np.uint64(63)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each of `begin`, `count` of them, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def points(texts: list[str]) -> np.ndarray:
    """The characters of texts, each with a space after it."""
    return np.frombuffer("".join([t + " " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(texts: list[str]) -> np.ndarray:
    there = np.zeros(0x110000, bool)
    there[points(texts)] = True
    return np.flatnonzero(there)


class Texts:
    """Texts as numbers: characters with and without spaces, and words, which a space alone divides. Characters are numbered
    by their place among `chars`, others all the same."""

    def __init__(self, texts: list[str], chars: np.ndarray):
        every = points(texts)
        place = np.full(0x110000, len(chars), np.int32)
        place[chars] = np.arange(len(chars))
        self.ids = place[every]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        space = every == 32
        ends = np.flatnonzero(space)  # of words: a text ends as a word does
        self.word_begin = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1] + 1])
        self.word_size = ends - self.word_begin
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(space)])
        self.first = before[self.begin]
        self.words = before[self.begin + self.size] - self.first + 1
        self.ns_ids = self.ids[~space]
        self.ns_begin = self.begin - self.first
        self.ns_size = self.size - self.words + 1
        known: dict[str, int] = {}
        self.word = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t.split(" ")), np.int64)
        self.vocabulary = known
        at = np.zeros(len(known), np.int64)
        at[self.word[::-1]] = np.arange(len(self.word))[::-1]
        self.known_begin, self.known_size = self.word_begin[at], self.word_size[at]


class Patterns:
    """Patterns of at most 64 characters, the last at the highest bit: below the first a row always matches."""

    def __init__(self, patterns: list[str], chars: np.ndarray):
        self.size = np.array([len(p) for p in patterns], np.int64)
        place = {chr(c): i for i, c in enumerate(chars.tolist())}
        self.width = len(chars) + 1
        masks = np.zeros((len(patterns), self.width), np.uint64)
        for row, p in enumerate(patterns):
            low = 64 - len(p)
            masks[row] = (1 << low) - 1
            for k, c in enumerate(p):
                if (i := place.get(c)) is not None:
                    masks[row, i] |= _ONE << np.uint64(low + k)
        self.masks = masks.ravel()


def distances(patterns: Patterns, row: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, anchored: bool = True, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of columns, each a pattern and a stretch of `ids`: the distances to the whole stretch and to its first `asked`
    characters (0 where none are asked). With `anchored` false the first is the least distance to any stretch of it."""
    n = len(row)
    whole, part = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-size, kind="stable")
    for low in range(0, n, COLUMNS):
        some = order[low : low + COLUMNS]
        lens = size[some]
        m = patterns.size[row[some]]
        base, pos = row[some] * patterns.width, begin[some].copy()
        d = m.astype(np.uint64)
        start = np.where(m > 0, _ONE << (64 - np.maximum(m, 1)).astype(np.uint64), np.uint64(0))
        up, down = ~(start - _ONE), np.zeros(len(some), np.uint64)
        best = d.copy()
        longest = int(lens[0])
        active_at = np.searchsorted(-lens, -np.arange(1, longest + 1), side="right").tolist()
        if asked is not None:
            wanted = asked[some]
            by_size = np.argsort(wanted, kind="stable")
            bounds = np.searchsorted(wanted[by_size], np.arange(longest + 2)).tolist()
            there = np.zeros(len(some), np.uint64)
        buffers = np.empty((5, len(some)), np.uint64)
        for j, a in enumerate(active_at):
            u, v = up[:a], down[:a]
            eq, xh, hp, hm, x = buffers[:, :a]
            np.take(patterns.masks, base[:a] + ids[pos[:a]], out=eq)
            pos[:a] += 1
            np.bitwise_and(eq, u, out=xh)
            xh += u
            xh ^= u
            xh |= eq
            np.bitwise_or(xh, u, out=hp)
            np.invert(hp, out=hp)
            hp |= v
            np.bitwise_and(u, xh, out=hm)
            np.bitwise_or(eq, v, out=eq)
            np.right_shift(hp, _TOP, out=x)
            d[:a] += x
            np.right_shift(hm, _TOP, out=x)
            d[:a] -= x
            hp <<= _ONE
            if anchored:
                hp |= start[:a]
            else:
                np.minimum(best[:a], d[:a], out=best[:a])
            hm <<= _ONE
            np.bitwise_or(eq, hp, out=x)
            np.invert(x, out=x)
            np.bitwise_or(x, hm, out=u)
            np.bitwise_and(hp, eq, out=v)
            if asked is not None and bounds[j + 1] < bounds[j + 2]:
                got = by_size[bounds[j + 1] : bounds[j + 2]]
                there[got] = d[got]
        whole[some] = d if anchored else best
        if asked is not None:
            part[some] = there
    return whole, part


def least(patterns: Patterns, row: np.ndarray, texts: Texts, vi: np.ndarray) -> np.ndarray:
    """The least distances to any stretch of texts without spaces. Beyond twice the pattern's length no stretch is nearer
    than the empty one, so where there are few pairs long texts are taken in pieces that overlap by so much."""
    begin, size = texts.ns_begin[vi], texts.ns_size[vi]
    if len(row) > COLUMNS // 4:
        return distances(patterns, row, texts.ns_ids, begin, size, anchored=False)[0]
    over = 2 * patterns.size[row]
    step = np.maximum(over, 32)
    pieces = np.maximum(1, -(-(size - over) // step))
    of = np.repeat(np.arange(len(row)), pieces)
    at = ranges(np.zeros(len(row), np.int64), pieces) * step[of]
    got = distances(patterns, row[of], texts.ns_ids, begin[of] + at, np.minimum(step[of] + over[of], size[of] - at), anchored=False)[0]
    return np.minimum.reduceat(got, np.cumsum(pieces) - pieces) if len(row) else got


class Asked:
    """Transcripts, to be scored with texts that are encoded by the same characters. `fits` tells whether their patterns are
    short enough."""

    def __init__(self, asked: list[str], chars: np.ndarray):
        self.split = [q.split(" ") for q in asked]
        self.n = np.array([len(t) for t in self.split], np.int64)
        self.q, self.qns = Patterns(asked, chars), Patterns(["".join(t) for t in self.split], chars)
        self.word_at = {w: i for i, w in enumerate(dict.fromkeys(w for t in self.split for w in t))}
        self.word = Patterns(list(self.word_at), chars)
        # What is left without the first one to four words, as far as these are half of them.
        self.tails = [" ".join(t[k:]) if k <= len(t) // 2 else "" for t in self.split for k in range(1, 5)]
        self.tail = Patterns(self.tails, chars)

    @staticmethod
    def fits(q: str) -> bool:
        return len(q) <= 64 and "" not in q.split(" ")

    def partials(self, t: Texts, qi: np.ndarray, vi: np.ndarray, nb: np.ndarray, partial: bool) -> np.ndarray:
        """`matching.partials_of` of pairs: transcripts `qi`, which don't fall, texts `vi` and those without the opening,
        `nb`, below 0 where there is none."""
        out = np.zeros((len(qi), 5))
        m, n, words, ns = self.qns.size[qi], self.n[qi], t.words[vi], t.ns_size[vi]
        has, nb = nb >= 0, np.maximum(nb, 0)
        wide = partial & (n >= 2) & (words >= 5)
        sliding = wide & (m < ns * 0.8)
        joined = sliding & (m >= 5) & (m < ns * 0.85)
        short = (ns > 0) & (m < 0.7 * ns)
        need = np.flatnonzero(short | joined)
        frag = np.zeros(len(qi))
        frag[need] = np.maximum(0.0, 1 - least(self.qns, qi[need], t, vi[need]) / m[need])
        out[:, 0] = np.where(short, frag, 0.0)
        need = np.flatnonzero(has & (t.ns_size[nb] > 0) & (m < 0.7 * t.ns_size[nb]))
        out[need, 1] = np.maximum(0.0, 1 - least(self.qns, qi[need], t, nb[need]) / m[need])
        out[:, 4] = np.where(joined, frag, 0.0)
        fewer = wide & (n < words * 0.8)
        first, second = np.flatnonzero(fewer), np.flatnonzero(fewer & has & (t.words[nb] >= 3))
        rest = np.flatnonzero(sliding & ~fewer)
        pair = np.concatenate([first, second, rest])
        if not len(pair):
            return out
        text = np.concatenate([vi[first], nb[second], vi[rest]])
        col = np.repeat([2, 3, -1], [len(first), len(second), len(rest)])
        slides = np.concatenate([sliding[first], np.zeros(len(second), bool), np.ones(len(rest), bool)])
        for low in range(0, len(pair), COLUMNS):
            some = slice(low, low + COLUMNS)
            self._runs(t, qi, pair[some], text[some], col[some], slides[some], out)
        for k in (first, second):
            self._words(t, qi[k], k, vi[k] if k is first else nb[k], 2 if k is first else 3, out)
        return out

    def _runs(self, t: Texts, qi: np.ndarray, pair: np.ndarray, text: np.ndarray, col: np.ndarray, slides: np.ndarray, out: np.ndarray) -> None:
        """As `matching._windows_of`: runs of one word less and one more from each word."""
        n, words = self.n[qi[pair]], t.words[text]
        count = np.maximum(1, words - n + np.where(col >= 0, 2, 1))
        of = np.repeat(np.arange(len(pair)), count)
        s = ranges(np.zeros(len(pair), np.int64), count)
        n, words, first, col, row = n[of], words[of], t.first[text][of], col[of], qi[pair][of]
        begin = t.word_begin[first + s]
        last = first + np.minimum(s + n + 1, words) - 1
        size = t.word_begin[last] + t.word_size[last] - begin
        less = s + n - 1
        end = first + np.clip(less, 1, words) - 1
        fewer = np.where((less >= 1) & (less <= words) & (col >= 0), t.word_begin[end] + t.word_size[end] - begin, 0)
        full, part = distances(self.q, row, t.ids, begin, size, asked=fewer)
        length = self.q.size[row]
        ratio = lambda d, x: (length + x - d) / np.maximum(1, length + x)
        whole = np.where(s + n + 1 <= words, ratio(full, size), 0.0)
        best = np.maximum(whole, np.where(fewer > 0, ratio(part, fewer), 0.0))
        slid = np.where(slides[of] & (s <= np.maximum(0, words - n)), ratio(full, size), 0.0)
        at = np.cumsum(count) - count
        best, slid, own = np.maximum.reduceat(best, at), np.maximum.reduceat(slid, at), col[at]
        for c in (2, 3):
            there = own == c
            out[pair[there], c] = np.maximum(out[pair[there], c], best[there])
        out[pair[slides], 4] = np.maximum(out[pair[slides], 4], slid[slides])  # a pair slides at most once

    def _words(self, t: Texts, qi: np.ndarray, pair: np.ndarray, text: np.ndarray, col: int, out: np.ndarray) -> None:
        """The best run of as many words by its words. Each word of a transcript meets each different word of its texts once."""
        enough = t.words[text] >= self.n[qi]
        qi, pair, text = qi[enough], pair[enough], text[enough]
        if not len(qi):
            return
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(qi)) + 1, [len(qi)]])
        seen, place = np.zeros(len(t.vocabulary), bool), np.zeros(len(t.vocabulary), np.int64)
        groups, rows, known = [], [], []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = text[low:high]
            flat = t.word[ranges(t.first[own], t.words[own])]
            seen[flat] = True
            some = np.flatnonzero(seen)
            seen[some] = False
            place[some] = np.arange(len(some))
            asked = [self.word_at[w] for w in self.split[int(qi[low])]]
            rows.append(np.repeat(asked, len(some)))
            known.append(np.tile(some, len(asked)))
            groups.append((low, high, place[flat], len(asked), len(some)))
        row, word = np.concatenate(rows), np.concatenate(known)
        a, b = self.word.size[row], t.known_size[word]
        d, _ = distances(self.word, row, t.ids, t.known_begin[word], b)
        every = np.where(b > 0, (a + b - d) / np.maximum(1, a + b), 0.0)
        used = 0
        for low, high, flat, n, some in groups:
            similar = every[used : used + n * some].reshape(n, some)
            used += n * some
            words = t.words[text[low:high]]
            count = words - n + 1
            start = ranges(np.cumsum(words) - words, count)
            total, hits = np.zeros(len(start)), np.zeros(len(start))
            for k in range(n):
                own = similar[k][flat[start + k]]
                total += own
                hits += own >= sc.WORD_MATCH
            got = np.maximum.reduceat(0.6 * (hits / n) + 0.4 * (total / n), np.cumsum(count) - count)
            out[pair[low:high], col] = np.maximum(out[pair[low:high], col], got)

    def raw(self, t: Texts, qi: np.ndarray, vi: np.ndarray, nb: np.ndarray, likely: np.ndarray, partial: bool) -> np.ndarray:
        """The greatest of a pair's scores, as `matching.score_pairs` has it; `likely` tells pairs with a bonus. Ratios are
        found only where the lengths let them be the greatest."""
        frag, frag_nb, window, window_nb, sliding = self.partials(t, qi, vi, nb, partial).T
        best = np.maximum(np.maximum(window * 0.95, window_nb * 0.95), sliding * 0.92)
        some = np.flatnonzero(likely & (self.n[qi] >= 2) & (t.words[vi] >= 2))
        if len(some):
            best[some] = np.maximum(best[some], self._tails(t, qi[some], vi[some]))
        for own, f in ((vi, frag), (np.maximum(nb, 0), frag_nb)):
            there = (own == vi) if own is vi else nb >= 0
            m, n = self.qns.size[qi], t.ns_size[own]
            there = there & (n > 0)
            short = m / np.maximum(n, 1) < 0.7
            best = np.where(there & short, np.maximum(best, f), best)
            most = (m + n - np.abs(m - n)) / np.maximum(1, m + n)
            reach = np.where(short, np.maximum(f, 0.6 * f + 0.4 * most) + 1e-9, most)
            some = np.flatnonzero(there & (reach > best) & (~short | (most > f - 1e-9)))
            d, _ = distances(self.qns, qi[some], t.ns_ids, t.ns_begin[own[some]], n[some])
            r = (m[some] + n[some] - d) / np.maximum(1, m[some] + n[some])
            best[some] = np.maximum(best[some], np.where(short[some], 0.6 * f[some] + 0.4 * r, r))
            m, n = self.q.size[qi], t.size[own]
            most = (m + n - np.abs(m - n)) / np.maximum(1, m + n)
            some = np.flatnonzero((nb >= 0 if own is not vi else True) & (most > best))
            d, _ = distances(self.q, qi[some], t.ids, t.begin[own[some]], n[some])
            best[some] = np.maximum(best[some], (m[some] + n[some] - d) / np.maximum(1, m[some] + n[some]))
        return best

    def _tails(self, t: Texts, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
        """As `score.suffix_prefix`."""
        ks = np.minimum(self.n[qi] // 2, 4)
        of = np.repeat(np.arange(len(qi)), ks)
        k = ranges(np.ones(len(qi), np.int64), ks)
        last = t.first[vi[of]] + np.minimum(self.n[qi[of]] - k, t.words[vi[of]]) - 1
        begin = t.begin[vi[of]]
        size = t.word_begin[last] + t.word_size[last] - begin
        row = qi[of] * 4 + k - 1
        d, _ = distances(self.tail, row, t.ids, begin, size)
        total = self.tail.size[row] + size
        return np.maximum.reduceat((total - d) / np.maximum(1, total), np.cumsum(ks) - ks)


def partials(asked: list[str], norm: list[str], no_bsm: list[str | None], partial: bool) -> np.ndarray:
    """`matching.partials_of` of pairs of transcripts that fit, in any order."""
    at = {q: i for i, q in enumerate(dict.fromkeys(asked))}
    place = {v: i for i, v in enumerate(dict.fromkeys([*norm, *(v for v in no_bsm if v is not None)]))}
    chars = alphabet(list(at))
    qi = np.array([at[q] for q in asked], np.int64)
    vi = np.array([place[v] for v in norm], np.int64)
    nb = np.array([-1 if v is None else place[v] for v in no_bsm], np.int64)
    order = np.argsort(qi, kind="stable")
    out = np.zeros((len(qi), 5))
    out[order] = Asked(list(at), chars).partials(Texts(list(place), chars), qi[order], vi[order], nb[order], partial)
    return out
