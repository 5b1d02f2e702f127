"""Edit distances of one pattern to many texts at once: bit-parallel over the pattern, numpy over the texts.

A column of the distance table is kept as vertical differences, 64 rows a word; every text has its own column, and one
step takes all texts on by a character. Texts are ordered by length, so that those that have ended leave the arrays.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def encoded(pattern: str, flat: str) -> tuple[np.ndarray, np.ndarray]:
    """Masks by character of the pattern, [words, characters + 1], and the place of each character of `flat` in them."""
    chars = np.unique(np.frombuffer(pattern.encode("utf-32-le", "surrogatepass"), np.uint32))
    place = {chr(c): i for i, c in enumerate(chars.tolist())}
    masks = np.zeros(((len(pattern) + 63) // 64, len(chars) + 1), np.uint64)
    for i, c in enumerate(pattern):
        masks[i >> 6, place[c]] |= _ONE << np.uint64(i & 63)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(np.searchsorted(chars, codes), len(chars) - 1)
    return masks, np.where(chars[at] == codes, at, len(chars))


def stretches(pattern: str, flat: str, starts: np.ndarray, lens: np.ndarray, anchored: bool = True, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches of one text: distances to the whole stretches, the least to any of their prefixes, and those to their
    first `asked` characters (0 where none are asked), all from one pass. With `anchored` false, to stretches of them that
    begin anywhere: the second is then the least distance to any stretch."""
    m, n = len(pattern), len(starts)
    if not m or not n:
        none = np.zeros(n, np.int64)
        return (lens if anchored else none), none, (asked if anchored and asked is not None else none)
    masks, ids = encoded(pattern, flat)
    order = np.argsort(-lens, kind="stable")
    sizes = lens[order]
    longest = int(sizes[0])
    codes = ids[np.minimum(starts[order] + np.arange(longest)[:, None], max(len(ids) - 1, 0))] if len(ids) else np.zeros((0, n), np.int64)
    active_at = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    wanted = np.zeros(n, np.int64) if asked is None else asked[order]
    by_size = np.argsort(wanted, kind="stable")
    bounds = np.searchsorted(wanted[by_size], np.arange(longest + 2))
    words, top = len(masks), np.uint64((m - 1) & 63)
    up = np.full((words, n), ~np.uint64(0))
    down = np.zeros((words, n), np.uint64)
    d = np.full(n, m, np.int64)
    best, there = d.copy(), d.copy()
    high = np.uint64(63)
    for j in range(longest):
        active = int(active_at[j])
        carry = np.zeros(active, np.uint64)
        hp_in = np.full(active, np.uint64(anchored))
        hm_in = np.zeros(active, np.uint64)
        for w in range(words):
            eq, u, v = masks[w][codes[j, :active]], up[w, :active], down[w, :active]
            xv = eq | v
            total = (eq & u) + u
            over = total < u
            if w:
                total += carry
                over |= (carry == _ONE) & (total == 0)
            if w < words - 1:
                carry = over.astype(np.uint64)
            xh = (total ^ u) | eq
            hp, hm = v | ~(xh | u), u & xh
            if w == words - 1:
                d[:active] += ((hp >> top) & _ONE).astype(np.int64) - ((hm >> top) & _ONE).astype(np.int64)
            else:
                hp_out, hm_out = hp >> high, hm >> high
            hp, hm = (hp << _ONE) | hp_in, (hm << _ONE) | hm_in
            if w < words - 1:
                hp_in, hm_in = hp_out, hm_out
            up[w, :active], down[w, :active] = hm | ~(xv | hp), hp & xv
        if not anchored:
            np.minimum(best[:active], d[:active], out=best[:active])
        if bounds[j + 1] < bounds[j + 2]:
            some = by_size[bounds[j + 1] : bounds[j + 2]]
            there[some] = d[some]
    out = np.empty((3, n), np.int64)
    out[:, order] = d, best, there
    return out[0], out[1], out[2]


def distances(pattern: str, texts: list[str], anchored: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the whole texts; and, with `anchored` false, the least distance to any stretch of each."""
    lens = np.array([len(t) for t in texts], np.int64)
    return stretches(pattern, "".join(texts), np.cumsum(lens) - lens, lens, anchored)[:2]


def ratios(pattern: str, texts: list[str]) -> np.ndarray:
    """(|a| + |b| - distance) / (|a| + |b|) of the pattern and every text; 1 for two empty ones."""
    total = np.array([len(t) for t in texts], np.float64) + len(pattern)
    return np.divide(total - distances(pattern, texts)[0], total, out=np.ones(len(texts)), where=total > 0)


def fragments(pattern: str, texts: list[str]) -> np.ndarray:
    """1 - distance to the best stretch / |pattern|, not below 0; 1 for an empty pattern."""
    if not pattern:
        return np.ones(len(texts))
    return np.maximum(0.0, 1 - distances(pattern, texts, anchored=False)[1] / len(pattern))


#: Characters of texts that are taken on together.
CELLS = 1 << 22


def nearest(patterns: list[str], texts: list[str]) -> np.ndarray:
    """The least distance of each pattern, of 1 to 64 characters, to any stretch of its own text: each pair is a column, one
    word high, and one step takes all pairs on by a character of their texts."""
    own = dict.fromkeys(patterns)
    chars = {c: i for i, c in enumerate(dict.fromkeys(c for p in own for c in p))}
    masks = np.zeros((len(own), len(chars) + 1), np.uint64)
    for i, p in enumerate(own):
        own[p] = i
        for k, c in enumerate(p):
            masks[i, chars[c]] |= _ONE << np.uint64(k)
    row = np.array([own[p] for p in patterns], np.int64) * (len(chars) + 1)
    size = np.array([len(p) for p in patterns], np.int64)
    lens = np.array([len(t) for t in texts], np.int64)
    order, out, flat = np.argsort(-lens, kind="stable"), size.copy(), masks.ravel()
    points = np.array([ord(c) for c in chars], np.uint32)
    by_point = np.argsort(points)
    low = 0
    while low < len(order) and lens[order[low]]:
        longest = int(lens[order[low]])
        some = order[low : low + max(1, CELLS // longest)]
        low += len(some)
        codes = np.frombuffer("".join([texts[i] for i in some.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = by_point[np.minimum(np.searchsorted(points[by_point], codes), len(points) - 1)]
        ids = np.where(points[at] == codes, at, len(points))
        n = lens[some]
        begins, base, top = np.cumsum(n) - n, row[some], (size[some] - 1).astype(np.uint64)
        up, down, d = np.full(len(some), ~np.uint64(0)), np.zeros(len(some), np.uint64), size[some].copy()
        best = d.copy()
        active_at = np.searchsorted(-n, -np.arange(1, longest + 1), side="right").tolist()
        for j, active in enumerate(active_at):
            u, v = up[:active], down[:active]
            eq = flat[base[:active] + ids[begins[:active] + j]]
            xv, xh = eq | v, (((eq & u) + u) ^ u) | eq
            hp, hm = v | ~(xh | u), u & xh
            d[:active] += ((hp >> top[:active]) & _ONE).astype(np.int64) - ((hm >> top[:active]) & _ONE).astype(np.int64)
            hp, hm = hp << _ONE, hm << _ONE
            up[:active], down[:active] = hm | ~(xv | hp), hp & xv
            np.minimum(best[:active], d[:active], out=best[:active])
        out[some] = best
    return out
