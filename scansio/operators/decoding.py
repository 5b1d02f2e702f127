"""Decoding of frame-wise token scores, hypotheses and two-stage retrieval."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(tokens: Sequence[int], pieces: dict[int, str]) -> str:
    return "".join(pieces.get(t, "") for t in tokens).replace("▁", " ").strip()


def greedy_of(frames: Sequence[Sequence[float]], pieces: dict[int, str], blank: int) -> str:
    """The best token of each frame, repeats joined, blanks dropped, word starts as spaces."""
    if not len(frames):
        return ""
    best = np.asarray([np.asarray(f) for f in frames]).argmax(axis=1)
    kept = best[(np.diff(best, prepend=-1) != 0) & (best != blank)]
    return _text(kept.tolist(), pieces)


def beam_of(frames: Sequence[Sequence[float]], pieces: dict[int, str], blank: int, width: int = 8, top: int = 20) -> list[tuple[str, float]]:
    """The `top` best texts of log probabilities by frame, with their log probabilities: prefixes of tokens are kept with
    the sums over all ways of aligning them, ending in a blank or not; `width` of them go on from frame to frame. Prefixes
    of one text are one."""
    beams: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, -np.inf)}
    for frame in frames:
        f = np.asarray(frame, np.float64)
        tokens = np.argsort(-f, kind="stable")[: width + 1].tolist()
        new: dict[tuple[int, ...], list[float]] = defaultdict(lambda: [-np.inf, -np.inf])
        for prefix, (ends, goes) in beams.items():
            whole = np.logaddexp(ends, goes)
            own = new[prefix]
            own[0] = np.logaddexp(own[0], whole + f[blank])
            if prefix:
                own[1] = np.logaddexp(own[1], goes + f[prefix[-1]])
            for t in tokens:
                if t != blank:
                    longer = new[*prefix, t]
                    longer[1] = np.logaddexp(longer[1], (ends if prefix and t == prefix[-1] else whole) + f[t])
        best = sorted(new.items(), key=lambda x: (-np.logaddexp(*x[1]), x[0]))[: max(width, top)]
        beams = {p: (a, b) for p, (a, b) in best}
    texts: dict[str, float] = {}
    for prefix, (a, b) in beams.items():
        text = _text(prefix, pieces)
        texts[text] = float(np.logaddexp(texts.get(text, -np.inf), np.logaddexp(a, b)))
    return sorted(texts.items(), key=lambda x: (-x[1], x[0]))[:top]


def forward_score_of(frames: Sequence[Sequence[float]], tokens: Sequence[int], blank: int) -> float:
    """Log probability of a sequence of tokens, summed over all its alignments with the frames (the forward pass)."""
    f = np.asarray([np.asarray(x, np.float64) for x in frames])
    states = [blank]
    for t in tokens:
        states += [t, blank]
    n = len(states)
    if not len(f):
        return 0.0 if not tokens else -np.inf
    at = np.asarray(states)
    # From two states before only between different tokens: repeats need the blank between them.
    skips = np.array([i >= 2 and states[i] != blank and states[i] != states[i - 2] for i in range(n)])
    alpha = np.full(n, -np.inf)
    alpha[: min(2, n)] = f[0][at[: min(2, n)]]
    for frame in f[1:]:
        one = np.concatenate([[-np.inf], alpha[:-1]])
        two = np.where(skips, np.concatenate([[-np.inf] * 2, alpha[:-2]])[:n], -np.inf)
        alpha = np.logaddexp(np.logaddexp(alpha, one), two) + frame[at]
    return float(np.logaddexp(alpha[-1], alpha[-2]) if n > 1 else alpha[-1])


def hypotheses(df: DataFrame, key: str, frames: str, pieces: dict[int, str], blank: int, width: int = 8, top: int = 20) -> DataFrame:
    """`key, hyp, text, log_prob`: a row for each of the best texts of every row's frames, the best first (hyp = 0)."""

    @F.pandas_udf("array<struct<text:string,log_prob:double>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [] if v is None else beam_of(v, pieces, blank, width, top))

    return df.select(key, F.posexplode(run(frames)).alias("hyp", "h")).select(key, "hyp", "h.*")


def rescored(df: DataFrame, frames: str, tokens: str, blank: int) -> DataFrame:
    """`df` with `log_prob`: how well the candidate in `tokens` explains the frames beside it; null if either is null."""

    @F.pandas_udf(T.DoubleType())
    def run(f: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else forward_score_of(a, list(b), blank) for a, b in zip(f, t)], dtype=float)

    return df.withColumn("log_prob", run(frames, tokens))


def greedy(frames: Column, pieces: dict[int, str], blank: int) -> Column:
    """Text of an array of frames (arrays of scores by token)."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda f: greedy_of(f, pieces, blank), na_action="ignore")

    return run(frames)


def best_hypothesis(matches: DataFrame) -> DataFrame:
    """Of the answers to several hypotheses of a query (qid, hyp, ..., score) the best; of equals the first."""
    rest = [c for c in matches.columns if c != "qid"]
    return matches.groupBy("qid").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("hyp"))).alias("m")).select("qid", "m.*")


def gated(first: DataFrame, rescore, gate: float = 0.7) -> DataFrame:
    """Answers of a first stage that reach the gate, and `rescore` of those that don't: rescoring sees only these."""
    return first.where(F.col("score") >= gate).unionByName(rescore(first.where(F.col("score") < gate)))
