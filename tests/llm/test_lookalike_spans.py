import random
from itertools import combinations

import pytest

from scansio.llm import lookalike as lk
from scansio.llm import spans

SAME = [("ａb", "ab"), ("ā", "ā"), ("a b", "a b"), ("­ab​", "ab"), (" ab ", "ab"), ("ﻣﻦ", "من"), ("بَّ", "بَّ"), ("kаn", "kan"), ("کان", "كان"), ("بیت", "بيت"), ("علی", "على"), ("منە", "منه"), ("ﻼ", "لا")]
DIFFERENT = [("ab", "aB"), ("a", "ā"), ("بَ", "بِ"), ("مِنۖ", "مِن"), ("مِنۖ", "مِنۗ"), ("ا", "ٱ"), ("علی", "علي"), ("ab", "a b"), ("من", "مـن"), ("۝", ""), ("сорока", "copoka")]


def readings(spark, values):
    """The class of each value, by the least place of a value of it."""
    df = spark.createDataFrame(list(enumerate(values)), "verse_id long, t string")
    form = {r.verse_id: r.canonical for r in lk.canonical(df, "verse_id", "t").collect()}
    return [form[i] for i in range(len(values))]


def test_readings(spark):
    got = readings(spark, [x for pair in SAME + DIFFERENT for x in pair])
    pairs = list(zip(got[::2], got[1::2]))
    for (a, b), (x, y), same in zip(SAME + DIFFERENT, pairs, [True] * len(SAME) + [False] * len(DIFFERENT)):
        assert (x == y) is same, (a, b)
        assert lk.mapped(lk.mapped(a)) == lk.mapped(a) and lk.mapped(lk.mapped(b)) == lk.mapped(b)
    assert lk.mapped(None) is None and lk.mapped("") == ""


def test_the_collation_decides(spark):
    """Composed and split accents and controls are left to it: the mapped forms differ, the class is one."""
    for a, b in (("\u0101b", "a\u0304b"), ("\uac00", "\u1100\u1161"), ("a\x01b", "ab"), ("\u0623", "\u0627\u0654")):
        assert lk.mapped(a) != lk.mapped(b)
        x, y = readings(spark, [a, b])
        assert x == y == min(lk.mapped(a), lk.mapped(b))


def test_marks_without_weight_keep_their_place(spark):
    """A pause mark after another word is another reading, though the collation doesn't see it."""
    x, y, z = readings(spark, ["\u0645\u0646\u06d6 \u0628", "\u0645\u0646 \u0628\u06d6", "\u0645\u0646 \u0628"])
    assert len({x, y, z}) == 3
    marks = lk.Marks(*lk.weightless(spark))
    assert marks("\u0645\u0646\u06d6 \u0628\u06d6") == "2\u06d64\u06d6" and marks("abc") == ""
    assert "\u06d6" in lk.weightless(spark)[0] and "\u064e" not in lk.weightless(spark)[0]


def test_pairs_and_forms(spark):
    values = [a for pair in SAME + DIFFERENT for a in pair] + ["", None, "\u200b", " "]
    rows = [(i, v, "x", "y") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, "ab", "x", "y")], "verse_id long, t string, field string, form string")
    got = {(r.a, r.b) for r in lk.same_reading_pairs(df, "verse_id", "t").collect()}
    form = {r.verse_id: r.canonical for r in lk.canonical(df, "verse_id", "t").collect()}
    key = {i: form[i] for i, v in enumerate(values) if v}
    want = {(i, j) for i, j in combinations(key, 2) if key[i] == key[j] != "" and values[i] != values[j]}
    assert got == want and want
    assert len(form) == len(values) and form[values.index(None)] is None
    links = lk.reading_classes(df, "verse_id", "t").collect()
    assert sum(r.links for r in links) == len(want) and all(r.spellings > 1 for r in links)
    empty = df.limit(0)
    assert lk.same_reading_pairs(empty, "verse_id", "t").count() == lk.canonical(empty, "verse_id", "t").count() == lk.reading_classes(empty, "verse_id", "t").count() == 0


def test_values_are_mapped_once(spark):
    """Records and classes read one table of mapped values; each of them mapped all values for itself."""
    df = spark.createDataFrame([(1, "ab"), (2, "a\u200bb"), (2, "a\u200bb")], "verse_id long, t string")
    for of in (lk.same_reading_pairs, lk.canonical, lk.reading_classes):
        got = of(df, "verse_id", "t")
        assert "ArrowEvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in lk.same_reading_pairs(df, "verse_id", "t").collect()] == [("t", 1, 2)]


def test_pairs_of_a_large_class_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lk, "PAIR_ROWS", 7)
    df = spark.createDataFrame([(i, "a\u200bb" if i % 3 else "ab") for i in range(40)], "verse_id long, t string")
    got = [(r.a, r.b) for r in lk.same_reading_pairs(df, "verse_id", "t").collect()]
    want = {(i, j) for i, j in combinations(range(40), 2) if bool(i % 3) != bool(j % 3)}
    assert len(got) == len(set(got)) and set(got) == want


def brute(rows, fields):
    out = set()
    for c, (f, n) in enumerate(fields.items(), 1):
        values = {r[0]: r[c] for r in rows if r[0] is not None and r[c] is not None}
        owners = {}
        for k, t in values.items():
            for p in range(len(t) - n + 1):
                owners.setdefault(t[p : p + n], set()).add(k)
        for k, t in values.items():
            shared = [False] * len(t)
            for p in range(len(t) - n + 1):
                if len(owners[t[p : p + n]]) > 1:
                    shared[p : p + n] = [True] * n
            start = None
            for i, s in enumerate([*shared, False]):
                if s and start is None:
                    start = i
                elif not s and start is not None:
                    out.add((f, k, start, i - start))
                    start = None
    return out


@pytest.mark.parametrize(("seed", "group", "shard"), [(1, 100_000, 100_000), (2, 1, 100_000), (3, 100_000, 60), (4, 150, 80)])
def test_spans_are_those_of_brute_force(spark, seed, group, shard):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abم") for _ in range(n))
    common = [word(rng.randint(10, 60)) for _ in range(6)]
    text = lambda: "".join(rng.choice([word(rng.randint(1, 20)), rng.choice(common)]) for _ in range(rng.randint(0, 8)))
    rows = [(i, text() or None, text()) for i in range(60)]
    rows += [(60, rows[3][1], "a" * 300), (61, rows[3][1], "a" * 100), (62, "", None), (63, "ab" * 200, "a" * 12), (None, rows[3][1], rows[3][2]), rows[7], rows[7]]
    fields = {"t": 12, "u": 20}
    df = spark.createDataFrame([(*r, "x") for r in rows], "verse_id long, t string, u string, field string")
    got = [tuple(r) for r in spans.shared_spans(df, "verse_id", fields, shard, group).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, fields)


def test_records_delivered_twice_are_one(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared = [word(40) for _ in range(4)]
    rows = [(i, word(20) + shared[i % 4] + word(20), None) for i in range(20)]
    df = lambda rows: spark.createDataFrame(rows, "verse_id long, t string, u string")
    once = {tuple(r) for r in spans.shared_spans(df(rows), "verse_id", {"t": 12}).collect()}
    twice = {tuple(r) for r in spans.shared_spans(df(rows + rows), "verse_id", {"t": 12}).collect()}
    assert once == twice == brute(rows, {"t": 12})
    # Anchors of different holders must not come together in one signature.
    found = spans.regions_of(df(rows + rows), "verse_id", {"t": 12})
    assert found.where("_sig = 0").count() == 0 and found.select("_sig").distinct().count() >= 4


def test_copies_meet_as_one_row(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(i, text) for i in range(1000)] + [(1000, text[100:400])]
    df = spark.createDataFrame(rows, "verse_id long, t string").repartition(4)
    got = {(r.verse_id, r.span_start, r.span_len) for r in spans.shared_spans(df, "verse_id", {"t": 60}).collect()}
    assert got == {(i, 0, 5000) for i in range(1000)} | {(1000, 0, 300)}
    found = spans.regions_of(df, "verse_id", {"t": 60})
    assert found.count() > 1000
    largest = max(r.n for r in spans.distinct_regions(found).selectExpr("_f", "_sig", "length(_text) AS c").groupBy("_f", "_sig").agg({"c": "sum"}).toDF("f", "s", "n").collect())
    assert largest < 10_000


def test_own_repeats_are_not_shared(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 5, None), (2, "x", None), (3, None, None)], "verse_id long, t string, u string")
    assert spans.shared_spans(df, "verse_id", {"t": 10, "u": 10}).count() == 0
    assert spans.shared_spans(df.limit(0), "verse_id", {"t": 10}).count() == 0
    assert {r.verse_id: r.shared_chars for r in spans.shared_totals(df, "verse_id", {"t": 10}).collect()} == {1: 0, 2: 0}


def test_automaton_against_search():
    rng = random.Random(9)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 40))) for _ in range(4)]
        a = spans.Automaton([(t, i, i) for i, t in enumerate(texts)])
        for i, t in enumerate(texts):
            got = [False] * len(t)
            for s, e in a.shared(t, i, 5):
                got[s:e] = [True] * (e - s)
            want = [False] * len(t)
            for p in range(len(t) - 4):
                if any(t[p : p + 5] in u for j, u in enumerate(texts) if j != i):
                    want[p : p + 5] = [True] * 5
            assert got == want
