"""Score queries over whole texts, against brute force on the shortest pairs of the smallest tables."""

import pytest

from scansio.plans import core_queries as cq
from tests.test_scores import table


def of(spark, sf, name):
    return {r.verse_id: r for r in cq.QUERIES[name](spark, sf).collect()}


@pytest.fixture(scope="module")
def pairs(spark, sf):
    return sorted(((r.verse_id, r.a, r.b) for r in cq._pairs(spark, sf).collect()), key=lambda r: len(r[1]) + len(r[2]))


def ratio(a, b):
    return (len(a) + len(b) - table(a, b)) / (len(a) + len(b))


def least_to_stretch(q, t):
    p = [0] * (len(t) + 1)
    for i, x in enumerate(q, 1):
        n = [i]
        for j, y in enumerate(t, 1):
            n.append(min(p[j] + 1, n[-1] + 1, p[j - 1] + (x != y)))
        p = n
    return min(p)


def test_partial_ratio_of_whole_texts(spark, sf, pairs):
    got = of(spark, sf, "partial_ratio_texts")
    assert len(got) == len(pairs)
    for v, a, b in pairs[:20]:
        s, t = sorted((a, b), key=len)
        assert got[v].best == pytest.approx(max(ratio(s, t[i : i + len(s)]) for i in range(len(t) - len(s) + 1)), abs=0.00051)


def test_fragments_of_whole_texts(spark, sf, pairs):
    got = of(spark, sf, "fragment_score_texts")
    assert len(got) == len(pairs)
    for v, a, b in pairs:
        d = least_to_stretch(a, b)
        assert got[v].distance == d and got[v].fragment == pytest.approx(max(0, 1 - d / len(a)), abs=0.00051)


def test_words_at_every_place(spark, sf, pairs):
    got = {(r.verse_id, r.pos): r for r in cq.QUERIES["word_match_places"](spark, sf).collect()}
    assert len(got) == sum(max(a.count(" "), b.count(" ")) + 1 for _, a, b in pairs)
    for v, a, b in pairs[:60]:
        x, y = a.split(" "), b.split(" ")
        for i in range(max(len(x), len(y))):
            r = got[v, i]
            if i >= min(len(x), len(y)):
                assert r.similarity is None and r.matches is None
                continue
            assert r.similarity == pytest.approx(ratio(x[i], y[i]), abs=0.00051)
            assert r.matches == (x[i] == y[i] or (min(len(x[i]), len(y[i])) > 2 and ratio(x[i], y[i]) >= 0.7))


def test_windows_of_all_words(spark, sf, pairs):
    got = of(spark, sf, "window_match")
    assert len(got) == len(pairs)
    for v, a, b in pairs[:60]:
        t, w = a.split(" "), b.split(" ")
        n, runs = len(t), []
        for i in range(len(w) - n + 1):
            r = [ratio(x, y) for x, y in zip(t, w[i : i + n])]
            runs.append((0.6 * sum(x >= 0.7 for x in r) / n + 0.4 * sum(r) / n, i, i + n))
        runs += [(ratio(a, " ".join(w[i : i + k])), i, i + k) for i in range(len(w)) for k in (n - 1, n + 1) if k and i + k <= len(w)]
        best = max(runs, key=lambda x: x[0], default=(0.0, 0, 0))
        if best[0] == 0:
            best = (0.0, 0, 0)
        assert got[v].score == pytest.approx(best[0], abs=0.00051) and (got[v].start, got[v].end) == best[1:]
