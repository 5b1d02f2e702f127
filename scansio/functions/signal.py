"""Functions of sample arrays (mono, -1 to 1) as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16_000
SILENCE_RMS, LEVEL_RMS = 0.005, 0.01
GAP_SAMPLES = 3200


def rms(samples: Column) -> Column:
    """Root of the mean of squares; null for no samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples)))


def is_silence(samples: Column) -> Column:
    return rms(samples) < SILENCE_RMS


def is_sound(samples: Column, window: int = 256) -> Column:
    """Whether the level meter shows anything: the last window is louder than LEVEL_RMS."""
    return rms(tail(samples, window)) > LEVEL_RMS


def tail(samples: Column, n: int) -> Column:
    """The last n samples, or all if there are fewer."""
    return F.when(F.size(samples) <= n, samples).otherwise(F.slice(samples, -n, n))


def joined(parts: Sequence[Column], gap: int = 0) -> Column:
    """Arrays one after another, with `gap` zero samples between them."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), gap)
    out: list[Column] = []
    for i, p in enumerate(parts):
        out += [p] if i == 0 or not gap else [zero, p]
    return F.concat(*out)


def to_float(ints: Column) -> Column:
    return F.transform(ints, lambda x: (x / F.lit(32768.0)).cast("float"))


def to_int16(samples: Column) -> Column:
    """Clamped to -1..1, scaled by 32768 below zero and 32767 above, cut to whole numbers."""

    def one(x: Column) -> Column:
        c = F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0))
        return F.when(c < 0, c * 32768).otherwise(c * 32767).cast("short")

    return F.transform(samples, one)


def resampled(samples: Column, rate: int, to: int = RATE) -> Column:
    """Every sample at floor(i * rate / to), exact over the whole array; phases don't start again at buffers."""
    n = F.floor(F.size(samples) * F.lit(to) / F.lit(rate)).cast("int")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(samples, F.floor(i * F.lit(rate) / F.lit(to)).cast("int")))
    return F.when(n > 0, at).otherwise(F.slice(samples, 1, 0))
