"""Series in array columns: downsampling, resampling, statistics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_stride(x: Column, keep: int) -> Column:
    """keep values at evenly spaced places (rounded half to even), or x itself if it has no more."""
    if keep < 1:
        raise ValueError("keep must be positive")
    place = lambda j: F.rint(j * (F.size(x) - 1) / (keep - 1)).cast("int") if keep > 1 else F.lit(0)
    return F.when(F.size(x) <= keep, x).otherwise(F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda j: F.get(x, place(j))))


def bin_mean(x: Column, bins: int) -> Column:
    """Means of bins of equal whole width; the tail is dropped; x itself if it has fewer values than bins."""
    if bins < 1:
        raise ValueError("bins must be positive")
    width = F.floor(F.size(x) / bins).cast("int")
    mean = lambda b: F.aggregate(F.slice(x, b * width + 1, width), F.lit(0.0), lambda a, v: a + v) / width
    return F.when(F.size(x) < bins, x).otherwise(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), mean))


def downsample(x: Column, scheme: str, n: int) -> Column:
    schemes = {"uniform_stride": uniform_stride, "bin_mean": bin_mean}
    if scheme not in schemes:
        raise ValueError(f"unknown scheme {scheme}")
    return schemes[scheme](x, n)


def linear_resample(x: Column, n: int) -> Column:
    """n values at evenly spaced places by linear interpolation; x itself if it has n."""
    size = F.size(x)
    at = lambda j: j * (size - 1) / (n - 1) if n > 1 else F.lit(0.0)
    low = lambda j: F.floor(at(j)).cast("int")
    one = lambda j: F.get(x, low(j)) + (at(j) - low(j)) * (F.get(x, F.least(low(j) + 1, size - 1)) - F.get(x, low(j)))
    return F.when(size == n, x).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def sd(x: Column, ddof: int = 0) -> Column:
    m = mean(x)
    return F.when(F.size(x) > ddof, F.sqrt(total(F.transform(x, lambda v: (v - m) * (v - m))) / (F.size(x) - ddof)))


def differences(x: Column) -> Column:
    return F.when(F.size(x) > 1, F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def mean_abs_difference(x: Column) -> Column:
    """Null for one value or none."""
    return mean(F.transform(differences(x), F.abs))


def hrv_time(ibi: Column) -> Column:
    """Time-domain measures of inter-beat intervals in ms as a struct: out-of-range intervals (below 250, above 2000) are dropped where
    there are any; null measures for fewer than four."""
    kept = F.filter(ibi, lambda v: (v >= 250) & (v <= 2000))
    steps = differences(kept)
    some = F.size(kept) >= 4
    measures = {
        "hrv_mean_nn": mean(kept),
        "hrv_sdnn": sd(kept, 1),
        "hrv_rmssd": F.sqrt(mean(F.transform(steps, lambda v: v * v))),
        "hrv_pnn50": 100.0 * F.size(F.filter(steps, lambda v: F.abs(v) > 50)) / F.size(steps),
        "hrv_mean_hr": 60000.0 / mean(kept),
    }
    return F.struct(*(F.when(some, v).alias(k) for k, v in measures.items()))
