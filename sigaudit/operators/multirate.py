"""Windows over channels of different rates, from samples; and windows looked up by their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _span(rates: dict[str, float], width: float, channel, t0):
    """First sample and number of samples of a window in a channel, both rounded half to even."""
    hz = F.create_map(*(F.lit(x) for k, r in rates.items() for x in (k, float(r))))
    size = F.create_map(*(F.lit(x) for k, r in rates.items() for x in (k, int(round(width * r)))))
    return F.rint(t0 * F.try_element_at(hz, channel)).cast("bigint"), F.try_element_at(size, channel)


def cut(samples: DataFrame, windows: DataFrame, rates: dict[str, float], width: float) -> DataFrame:
    """windows with `channels`, a map of a channel to its samples (float) in the window, and `dropped`: null, "short" where a channel does
    not reach to the window's end, or else "not finite" where a sample is missing or not finite; channels of those are null.

    samples: recording, channel, i, v; windows: recording, t0 and more. Samples meet windows in buckets of one window's length a channel,
    so no recording is gathered: the largest group is one window. Samples of other channels are not read; a sample that is there twice
    makes its window longer than it can be, which is an error. A window of a recording without samples is short.
    """
    names = sorted(rates)
    if any(int(round(width * rates[c])) < 1 for c in names):
        raise ValueError("a window without samples")
    own = windows.withColumn("_w", F.struct("recording", *(c for c in windows.columns if c != "recording")))
    wanted = own.select("recording", "_w", "t0", F.explode(F.array(*(F.lit(c) for c in names))).alias("channel"))
    first, size = _span(rates, width, F.col("channel"), F.col("t0"))
    wanted = wanted.withColumn("first", first).withColumn("size", size).drop("t0")
    # a bucket is one window long: a window lies in two of them
    low = F.floor(F.col("first") / F.col("size"))
    wanted = wanted.withColumn("bucket", F.explode(F.array(low, low + 1)))
    given = samples.where(F.col("channel").isin(*names)).select("recording", "channel", "i", F.col("v").cast("double").alias("v"))
    many = F.create_map(*(F.lit(x) for c in names for x in (c, int(round(width * rates[c])))))
    given = given.withColumn("bucket", F.floor(F.col("i") / F.try_element_at(many, F.col("channel"))))
    met = wanted.join(given, ["recording", "channel", "bucket"]).where((F.col("i") >= F.col("first")) & (F.col("i") < F.col("first") + F.col("size")))
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    part = met.groupBy("_w", "channel", "size").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.sort_array(F.collect_list(F.struct("i", F.col("v").cast("float").alias("v")))).alias("x"))
    twice = F.col("n") > F.col("size")
    part = part.withColumn("n", F.when(twice, F.raise_error(F.lit("a sample is there twice")).cast("bigint")).otherwise(F.col("n")))
    whole = part.groupBy("_w").agg(
        F.count_if(F.col("n") == F.col("size")).alias("full"), F.sum("bad").alias("bad"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", F.transform("x", lambda s: s["v"]).alias("x"))))).alias("channels"),
    )
    out = own.join(whole, "_w", "left")
    reason = F.when(F.coalesce(F.col("full"), F.lit(0)) < len(names), "short").when(F.col("bad") > 0, "not finite")
    return out.select(*windows.columns, F.when(reason.isNull(), F.col("channels")).alias("channels"), reason.alias("dropped"))


def drops(cut_: DataFrame, key: str = "recording") -> DataFrame:
    """Per key, and in all (null key): windows, those kept, and those dropped by reason."""
    return cut_.rollup(key).agg(F.count("*").alias("n_windows"), F.count_if(F.col("dropped").isNull()).alias("n_kept"), F.count_if(F.col("dropped") == "short").alias("n_short"), F.count_if(F.col("dropped") == "not finite").alias("n_not_finite"))


def lookup(wanted: DataFrame, windows: DataFrame, keys: list[str], tolerance: float = 1e-3) -> DataFrame:
    """wanted (keys, t0 and more) with the window of the same keys whose t0 is within tolerance, as the struct `found`; the nearest of
    several, the earlier of two as near; null where there is none. Times meet in buckets of the tolerance and their neighbours, so no pair
    of rows farther off is formed."""
    bucket = lambda t: F.floor(t / tolerance)
    near = windows.select(*keys, F.struct(*windows.columns).alias("found"), F.explode(F.array(*(bucket(F.col("t0")) + k for k in (-1, 0, 1)))).alias("_bucket"))
    own = wanted.withColumn("_row", F.struct(*wanted.columns)).withColumn("_bucket", bucket(F.col("t0")))
    gap = F.abs(F.col("t0") - F.col("found.t0"))
    met = own.join(near, [*keys, "_bucket"]).where(gap <= tolerance)
    best = met.groupBy("_row").agg(F.min_by("found", F.struct(gap, F.col("found.t0"))).alias("found"))
    return own.join(best, "_row", "left").select(*wanted.columns, "found")


def found_or_raise(looked: DataFrame) -> DataFrame:
    """The result of lookup(), with a job that fails at the first row without a window."""
    ids = [c for c in looked.columns if c != "found"]
    guard = F.when(F.col("found").isNull(), F.raise_error(F.concat(F.lit("no window at "), F.to_json(F.struct(*ids)))).cast("boolean")).otherwise(F.lit(True))
    return looked.where(guard)


def exclusions(windows: DataFrame, least: int = 1, key: str = "subject", label: str = "y") -> DataFrame:
    """Per subject its windows of each class and why it is left out: `class` with fewer than least windows of a class; null: it stays."""
    out = windows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("n_0"), F.count_if(F.col(label) == 1).alias("n_1"))
    return out.withColumn("excluded", F.when((F.col("n_0") < least) | (F.col("n_1") < least), F.lit("class")))


