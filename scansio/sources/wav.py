"""WAV files: 16-bit PCM as sample arrays, by Arrow batches."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIND = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))])


def decode(data: bytes | None) -> tuple[int | None, int | None, np.ndarray | None]:
    """Rate, channels and samples of RIFF bytes. Chunks are walked one by one, each padded to an even size; bytes that
    are no WAV of 16 bits, or end before the data, give nulls or what there is of the data."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None, None, None
    at, rate, channels, bits = 12, None, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            if bits not in (None, 16):
                return rate, channels, None
            body = data[at + 8 : at + 8 + size]
            return rate, channels, np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768
        at += 8 + size + size % 2
    return rate, channels, None


def encode(samples, rate: int = 16_000) -> bytes:
    """A mono WAV of 16 bits; values beyond -1..1 are clamped."""
    x = np.clip(np.asarray(samples, np.float64), -1, 1)
    body = np.where(x < 0, x * 32768, x * 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(body))
    return head + body


def decoded(content: Column) -> Column:
    @F.pandas_udf(KIND)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(x) for x in data], columns=KIND.names)

    return run(content)


def encoded(samples: Column, rate: int = 16_000) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else encode(v, rate) for v in values])

    return run(samples)


def read(spark: SparkSession, path: str) -> DataFrame:
    """`path, rate, channels, samples` of WAV files."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("w")).select("path", "w.*")
