"""A registry of recognisers under test: each answers for a file, and says how large it is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Experiment:
    """predict: a path to surah, ayah, ayah_end and score (missing ones null); model_size: bytes."""

    predict: Callable[[str], dict]
    model_size: Callable[[], int]


_experiments: dict[str, Experiment] = {}


def register(name: str, predict: Callable[[str], dict], model_size: Callable[[], int] = lambda: 0) -> Experiment:
    """An experiment under a name of its own."""
    if name in _experiments:
        raise ValueError(f"{name} is registered already")
    _experiments[name] = Experiment(predict, model_size)
    return _experiments[name]


def list_models() -> list[str]:
    return sorted(_experiments)


def get(name: str) -> Experiment:
    return _experiments[name]


def predictions(samples: DataFrame, name: str, key: str = "sample_id", path: str = "file") -> DataFrame:
    """`qid, surah, ayah, ayah_end, score` of every sample that the experiment answers, as `evaluation` takes them."""
    predict = get(name).predict

    @F.pandas_udf("surah int, ayah int, ayah_end int, score double")
    def run(paths: pd.Series) -> pd.DataFrame:
        rows = [(predict(p) or {}) if p is not None else {} for p in paths]
        whole = {c: pd.Series([r.get(c) for r in rows], dtype="Int32") for c in ("surah", "ayah", "ayah_end")}
        return pd.DataFrame(whole | {"score": pd.Series([r.get("score") for r in rows], dtype=float)})

    return samples.select(F.col(key).alias("qid"), run(path).alias("p")).select("qid", "p.*").where("surah IS NOT NULL")
