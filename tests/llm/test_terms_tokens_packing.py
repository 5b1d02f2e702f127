import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scansio.llm import packing, terms, tokens

VERSE = "verse_id long, text_words array<string>, text_norm string, term string, mark string"


def test_terms(spark):
    rows = [(1, ["a", "a", "b", ""], "x", "t", "m"), (1, ["a", "a", "b", ""], "x", "t", "m"), (2, None, "a  c", "t", "m"), (3, [], "q", "t", "m"), (4, None, None, "t", "m"), (5, ["a", None], None, "t", "m"), (None, ["z"], "z", "t", "m")]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.verse_word_frequencies(spark.createDataFrame(rows, VERSE)).collect()}
    assert got == {"a": (4, 3, "common"), "b": (1, 1, "rare"), "c": (1, 1, "rare")}
    values = {r.term: r.records for r in terms.verse_value_frequencies(spark.createDataFrame(rows, VERSE)).collect()}
    assert values == {"x": 1, "a  c": 1, "q": 1}
    assert terms.verse_word_frequencies(spark.createDataFrame([], VERSE)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    pytest.importorskip("public_tokenizers")
    return tokens.Encoder.of()


PARTS = st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "é", "َ", "م", "1", "'s", "'", "!", "中", "🙂", "\r\n", "the", "ing", "aaaa"]), max_size=60).map("".join)


@given(PARTS, st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_trees_are_exact(text, leaf):
    encoder = tokens.Encoder.of()
    assert tokens.encode_text(text, encoder, leaf) == encoder.bpe.encode_ordinary(text)


def test_long_runs_are_exact(encoder):
    rng = random.Random(1)
    for text in ("a" * 9000, " " * 5000 + "x", "ab" * 5000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "م" * 3000):
        for leaf in (64, 1000):
            assert tokens.encode_text(text, encoder, leaf) == encoder.bpe.encode_ordinary(text)


def test_corpus(spark, encoder):
    texts = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "ab " * 400, "x"), (4, "ab " * 400, "x"), (None, "c" * 300, "x"), (2**62 + 1, "d e " * 99, "x")]
    got = tokens.encode_corpus(spark.createDataFrame(texts, "doc_id long, text string, ids string"), leaf_chars=100).collect()
    want = Counter((k, tuple(encoder.bpe.encode_ordinary(t or ""))) for k, t, _ in texts)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
@settings(max_examples=80, deadline=None)
def test_patterns_hold_everything(histogram):
    patterns = packing.shortest_pack_first(histogram, 50)
    held = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 50
        for s in pattern:
            held[s] += n
    assert held == Counter(histogram)
    total = sum(s * n for s, n in histogram.items())
    assert sum(n for _, n in patterns) <= 2 * -(-total // 50) + 1


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 5, 5, 20, 33, 100, 101, 250])) for i in range(500)] + [(1000, None), (1001, 1000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n int"), "doc_id", "n", 100).toPandas()
    real = got.dropna(subset=["container"])
    assert (real.groupby("container")["size"].sum() <= 100).all()
    assert set(real.container.astype(int)) == set(range(int(real.container.max()) + 1))
    assert all(sorted(p) == list(range(len(p))) for p in real.groupby("container").place.apply(list))
    sizes = got.groupby("doc_id")["size"].sum().to_dict()
    assert sizes == {k: n or 0 for k, n in rows}
    split = got[got.doc_id == 1001]
    assert sorted(split["offset"]) == list(range(0, 1000, 100)) and set(split["size"]) == {100}
    assert len(got[got.doc_id.isin([k for k, n in rows if n and n <= 100])]) == sum(1 for _, n in rows if n and n <= 100)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n int"), "doc_id", "n").count() == 0


def test_ranks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 10)
    got = packing.pack(spark.range(200).selectExpr("id AS doc_id", "7 AS n"), "doc_id", "n", 30).toPandas()
    assert len(got) == 200 and got.groupby("container").size().tolist() == [4] * 50
