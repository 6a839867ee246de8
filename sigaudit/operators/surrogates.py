"""Null surrogates of array channels: pooled moments, flat lines, noise, spectrum-preserving randomisation, donors from other subjects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import draw


def pooled_moments(windows: DataFrame, x: str = "x") -> DataFrame:
    """Mean and population variance over all samples of all windows, from sums a window: one row."""
    one = F.struct(F.size(x).alias("n"), F.aggregate(F.col(x), F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate(F.col(x), F.lit(0.0), lambda a, v: a + v * v).alias("q"))
    sums = windows.select(one.alias("m")).agg(F.sum("m.n").alias("n"), F.sum("m.s").alias("s"), F.sum("m.q").alias("q"))
    m = F.col("s") / F.col("n")
    return sums.select("n", m.alias("mean"), F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)).alias("var"))


def flatline(windows: DataFrame, x: str = "x") -> DataFrame:
    """Every sample is the pooled mean."""
    return windows.crossJoin(F.broadcast(pooled_moments(windows, x).select("mean"))).withColumn(x, F.array_repeat(F.col("mean"), F.size(x))).drop("mean")


def _row_rng(seed: int, key: str) -> np.random.Generator:
    import zlib

    return np.random.default_rng(np.random.SeedSequence(entropy=seed, spawn_key=(zlib.crc32(key.encode()),)))


def gaussian(windows: DataFrame, seed: int, x: str = "x", row: str = "window_id") -> DataFrame:
    """Normal noise of the pooled moments. The stream is keyed by row, so results do not depend on partitioning."""

    @F.pandas_udf("array<double>")
    def noise(key: pd.Series, size: pd.Series, mean: pd.Series, var: pd.Series) -> pd.Series:
        return pd.Series([_row_rng(seed, k).normal(m, np.sqrt(v), n) for k, n, m, v in zip(key, size, mean, var, strict=True)])

    pooled = pooled_moments(windows, x).select("mean", "var")
    return windows.crossJoin(F.broadcast(pooled)).withColumn(x, noise(row, F.size(x), "mean", "var")).drop("mean", "var")


def iaaft_rows(x: np.ndarray, start: np.ndarray, iterations: int = 20) -> np.ndarray:
    """Amplitude-adjusted Fourier surrogates of rows: the values of start, dealt out anew until they go with the spectrum of x.

    The amplitudes of the result's spectrum are those of x; its values are close to those of x.
    """
    size = x.shape[1]
    amplitude = np.abs(np.fft.rfft(x))
    values = np.sort(x)
    surrogate = start.astype(float)
    for step in range(iterations + 1):
        bins = np.fft.rfft(surrogate)
        length = np.abs(bins)
        phase = np.divide(bins, length, out=np.ones_like(bins), where=length > 0)
        smooth = np.fft.irfft(amplitude * phase, n=size)
        if step == iterations:
            return smooth
        # the smallest place gets the smallest value, and so on
        np.put_along_axis(surrogate, smooth.argsort(kind="stable"), values, axis=1)
    return surrogate


def iaaft(windows: DataFrame, seed: int, x: str = "x", row: str = "window_id") -> DataFrame:
    schema = windows.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done: list = [None] * len(frame)
            sizes = frame[x].map(len).to_numpy()
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                if n < 4:
                    raise ValueError("a series needs four samples")
                rows = np.stack(frame[x].iloc[at].to_list()).astype(float)
                start = np.stack([_row_rng(seed, k).permutation(r) for k, r in zip(frame[row].iloc[at], rows, strict=True)])
                for i, r in zip(at, iaaft_rows(rows, start), strict=True):
                    done[i] = r
            yield frame.assign(**{x: done})

    return windows.mapInPandas(run, schema)


def donors(windows: DataFrame, seed: int, same_class: bool, key: str = "subject", row: str = "window_id", label: str = "y") -> DataFrame:
    """(row, donor): for each window one of another subject (and, with same_class, of its class), drawn evenly. Candidates are numbered
    subject by subject; a draw over all but the own block is shifted past it, so no pair of rows is formed."""
    keys = [label] if same_class else []
    rows = windows.select(key, row, *keys)
    sizes = rows.groupBy(*keys, key).agg(F.count("*").alias("own"))
    blocks = sizes.withColumn("a", F.coalesce(F.sum("own").over(Window.partitionBy(*keys).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("own").over(Window.partitionBy(*keys)))
    place = F.row_number().over(Window.partitionBy(*keys, key).orderBy(row)) - 1
    placed = rows.withColumn("r", place).join(blocks, [*keys, key]).withColumn("at", F.col("a") + F.col("r"))
    d = draw(F.col("all") - F.col("own"), seed, F.col(row))
    wanted = placed.where(F.col("all") > F.col("own")).select(*keys, row, F.when(d < F.col("a"), d).otherwise(d + F.col("own")).alias("at"))
    return wanted.join(placed.select(*keys, "at", F.col(row).alias("donor")), [*keys, "at"]).select(row, "donor")


def permuted(features: DataFrame, pairs: DataFrame, columns: list[str], row: str = "window_id") -> DataFrame:
    """features with the donor's values in columns; ids and labels stay the target's."""
    given = features.select(F.col(row).alias("donor"), *columns)
    return features.drop(*columns).join(pairs, row).join(given, "donor")


def deleted_text(channel: Column) -> Column:
    return F.concat(channel, F.lit(": signal deleted"))
