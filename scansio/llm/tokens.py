"""Encoding of a corpus with a public byte-level BPE tokenizer, exact for texts of any length.

A text of up to `leaf_chars` code points is one leaf and is encoded as it is. A longer one is cut into leaves that are
encoded in parallel, wherever they lie; the encodings are then joined two by two, as a tree. Two encodings rarely just
follow each other at a join: the cut may stand within a piece of the splitting pattern, or within a run of merges. So a
window around the join is encoded anew, and grows until both sides agree with it exactly:

* The splitting pattern looks ahead by one character and never back. From any place where a piece begins, the pieces
  that follow depend only on what is right of it. A window that begins at a piece of the left side, and in which a piece
  begins where one begins on the right side, with the rest of the window beyond it, has the pieces of the whole text;
  what lies beyond is unchanged.
* Where one piece is so long that a whole side lies within it, no such place exists. Then the tokens of the piece are
  joined: a sequence of tokens is the encoding of its bytes if and only if every two neighbours are the encoding of
  theirs (each merge that would cross a boundary is decided by the two tokens that meet there). The window begins with
  the last token of the left and the first of the right and grows by tokens until the tokens at both of its ends come
  out as they were.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a leaf of the tree.
LEAF_CHARS = 4096
#: The vocabulary that the queries use.
VOCABULARY = "byte_bpe_50k.tiktoken"

_encoders: dict[str, Encoder] = {}


def vocabulary_path(path: str | None = None) -> str:
    """The rank file at `path`, or the one of the installed package of public vocabularies."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ranks, splitting pattern and a tiktoken encoding of them."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(vocabulary_path(path), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("scansio", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    @staticmethod
    def of(path: str | None = None) -> Encoder:
        """The worker's only encoder for `path`."""
        key = path or ""
        if key not in _encoders:
            _encoders[key] = Encoder(path)
        return _encoders[key]

    def piece(self, raw: bytes) -> list[int]:
        """Tokens of bytes that are one piece of the splitting pattern, or part of one."""
        got = self.ranks.get(raw)
        return [got] if got is not None else self.bpe._encode_single_piece(raw)

    def leaf(self, text: str) -> Node:
        """The encoding of a text with the places of its pieces: in the text and in the tokens."""
        starts, at, ids = [], [], []
        for m in self.split.finditer(text):
            starts.append(m.start())
            at.append(len(ids))
            ids += self.piece(m.group().encode())
        return Node(text, ids, starts, at)

    def join(self, left: Node, right: Node) -> Node:
        """The encoding of the concatenation of two texts, from theirs."""
        if not left.text or not right.text:
            return right if not left.text else left
        size, n = len(left.text), len(left.starts)
        text = left.text + right.text
        # The last piece may go on in the right text, and the one before it may have looked at its end: the window begins
        # with these two, which no text to the right can change the begin of, and grows to the right only.
        first = max(0, n - 2)
        fresh, k = self._meet(text, left.starts[first], size, right)
        starts, at, ids = left.starts[:first], left.at[:first], left.ids[: left.at[first]]
        for s, e in fresh:
            starts.append(s)
            at.append(len(ids))
            ids += self._span(text, s, e, left, right, size)
        if k < len(right.starts):
            shift = len(ids) - right.at[k]
            starts += [s + size for s in right.starts[k:]]
            at += [a + shift for a in right.at[k:]]
            ids += right.ids[right.at[k] :]
        return Node(text, ids, starts, at)

    def _meet(self, text: str, begin: int, size: int, right: Node) -> tuple[list[tuple[int, int]], int]:
        """The pieces from `begin` up to the first that begins on the right side where one of its own does, and which
        of them that is. The window grows by a piece at a time."""
        own = {s + size: k for k, s in enumerate(right.starts[1:], 1)}
        fresh, at = [], begin
        while at < len(text):
            if at in own:
                return fresh, own[at]
            m = self.split.match(text, at)
            fresh.append((at, m.end()))
            at = m.end()
        return fresh, len(right.starts)

    def _span(self, text: str, start: int, end: int, left: Node, right: Node, size: int) -> list[int]:
        """The tokens of a new piece; what it has of a long piece on either side isn't encoded again."""
        if start >= size or end <= size or end - start < 64:
            return self.piece(text[start:end].encode())
        a = self._within(left, start, size)
        b = self._within(right, 0, end - size)
        return self._zip(a, b)

    def _within(self, node: Node, start: int, end: int) -> list[int]:
        """Tokens of node.text[start:end], which lies within one piece of the whole text; those of the node's own piece
        if it is one."""
        for k, s in enumerate(node.starts):
            if s == start:
                stop = node.starts[k + 1] if k + 1 < len(node.starts) else len(node.text)
                if stop == end:
                    return node.ids[node.at[k] : node.at[k + 1] if k + 1 < len(node.at) else len(node.ids)]
            if s > start:
                break
        return self.piece(node.text[start:end].encode())

    def _zip(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of two token sequences that are encodings of theirs."""
        i, j = 1, 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            got = self.piece(b"".join(self.bytes_of[x] for x in [*a[len(a) - i :], *b[:j]]))
            kept_left = i == len(a) or got[0] == a[-i]
            kept_right = j == len(b) or got[-1] == b[j - 1]
            if kept_left and kept_right and (i == len(a) or self._apart(a[-i - 1], got[0])) and (j == len(b) or self._apart(got[-1], b[j])):
                return a[: len(a) - i] + got + b[j:]
            i, j = (i if kept_left and i == len(a) else i * 2), (j if kept_right and j == len(b) else j * 2)

    def _apart(self, x: int, y: int) -> bool:
        """Whether two tokens, one after the other, are the encoding of their bytes."""
        return self.piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]


class Node:
    """A text, its tokens, and of each piece the place in the text and in the tokens."""

    __slots__ = ("at", "ids", "starts", "text")

    def __init__(self, text: str, ids: list[int], starts: list[int], at: list[int]):
        self.text, self.ids, self.starts, self.at = text, ids, starts, at

    def pack(self) -> bytes:
        """Tokens and the lengths of pieces, in text and in tokens."""
        lengths = [np.diff(x, append=[end]) for x, end in ((self.starts, len(self.text)), (self.at, len(self.ids)))]
        return b"".join(np.asarray(x, np.uint32).tobytes() for x in ([len(self.ids)], self.ids, *lengths))

    @staticmethod
    def unpack(text: str, packed: bytes) -> Node:
        n, *rest = np.frombuffer(packed, np.uint32).tolist()
        pieces = (len(rest) - n) // 2
        starts, at = (list(accumulate(x[:-1], initial=0)) if x else [] for x in (rest[n : n + pieces], rest[n + pieces :]))
        return Node(text, rest[:n], starts, at)


def join_all(encoder: Encoder, nodes: list[Node]) -> Node:
    """Neighbours are joined two by two until one is left."""
    while len(nodes) > 1:
        nodes = [encoder.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def cut_text(text: str, leaf_chars: int) -> list[str]:
    return [text[i : i + leaf_chars] for i in range(0, len(text), leaf_chars)]


def encode_text(text: str | None, encoder: Encoder, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Token ids of one text by the tree; an empty and a null text give the empty list."""
    if not text:
        return []
    if len(text) <= leaf_chars:
        return encoder.bpe.encode_ordinary(text)
    return join_all(encoder, [encoder.leaf(x) for x in cut_text(text, leaf_chars)]).ids


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS, path: str | None = None) -> DataFrame:
    """`key, ids` of every row; null and empty texts give the empty list, repeated keys repeated rows.

    Texts of one leaf go through one Arrow pass without a shuffle. Only the leaves of longer texts are shuffled: once
    to spread them over the cluster, once to bring the encodings of a text together, in pairs of leaves' own order.
    The second holds one text in a task, as its row did and its result does.
    """
    docs = docs.select(F.col(key), F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    short = docs.where(F.col("_text").isNull() | (F.length("_text") <= leaf_chars))
    # The row's place keeps repeated keys apart; as text, a null key stays null and a large one exact.
    long = docs.where(F.length("_text") > leaf_chars).select(F.col(key).cast("string").alias("_key"), F.monotonically_increasing_id().alias("_row"), "_text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            got = encoder.bpe.encode_ordinary_batch([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], names=[key, "ids"])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, row, t in zip(pdf["_key"], pdf["_row"], pdf["_text"]):
                parts = cut_text(t, leaf_chars)
                for at in range(0, len(parts), 256):
                    some = parts[at : at + 256]
                    yield pd.DataFrame({"_key": [k] * len(some), "_row": row, "_at": range(at, at + len(some)), "_leaf": some})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(path)
        for pdf in batches:
            yield pdf.assign(_packed=[encoder.leaf(t).pack() for t in pdf["_leaf"]])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        encoder = Encoder.of(path)
        pdf = pdf.sort_values("_at")
        node = join_all(encoder, [Node.unpack(t, p) for t, p in zip(pdf["_leaf"], pdf["_packed"])])
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1].values, "ids": [node.ids]})

    spread = long.mapInPandas(leaves, "_key string, _row long, _at long, _leaf string").repartition("_row", "_at")
    coded = spread.mapInPandas(encode, "_key string, _row long, _at long, _leaf string, _packed binary")
    trees = coded.groupBy("_row").applyInPandas(joined, "_key string, ids array<int>")
    return short.mapInArrow(whole, f"{key} {kind}, ids array<int>").unionByName(trees.select(F.col("_key").cast(kind).alias(key), "ids"))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS, path: str | None = None) -> DataFrame:
    """`key, n_tokens` of every row, 0 for null and empty texts."""
    return encode_corpus(docs, key, text, leaf_chars, path).select(key, F.size("ids").alias("n_tokens"))
