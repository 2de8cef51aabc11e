"""PCM helpers over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FULL_SCALE = 32767


def chunks(samples: Column, size: int) -> Column:
    """Consecutive slices of ``size`` samples; the last one may be shorter."""
    starts = F.when(
        F.size(samples) > 0, F.sequence(F.lit(1), F.size(samples), F.lit(size))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(samples, i, F.lit(size)))


def to_int16(samples: Column) -> Column:
    """Scale floats in [-1, 1] to 16 bit, truncating towards zero."""
    return F.transform(samples, lambda x: (x * F.lit(FULL_SCALE).cast("float")).cast("smallint"))


def to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: x.cast("float") / F.lit(FULL_SCALE).cast("float"))


def frame_rms(frame: Column) -> Column:
    squares = F.aggregate(frame, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(F.try_divide(squares, F.size(frame)))


def zero_crossing_rate(frame: Column) -> Column:
    """Share of neighbouring samples whose signs differ (zero counts as positive)."""
    pairs = F.greatest(F.size(frame) - 1, F.lit(0))
    left = F.slice(frame, F.lit(1), pairs)
    right = F.slice(frame, F.lit(2), pairs)
    flips = F.zip_with(left, right, lambda a, b: F.when((a < 0) != (b < 0), 1.0).otherwise(0.0))
    crossings = F.aggregate(flips, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(crossings, F.size(frame))
