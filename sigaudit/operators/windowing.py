"""Labelled segments and hopping windows that never cross them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_runs(samples: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...], fs: float = 1.0) -> DataFrame:
    """Runs of one code in samples (recording, i, code) as segments [start_s, end_s): label 1 for positive codes, 0 for negative ones.
    Other codes split runs and are dropped."""
    w = Window.partitionBy("recording").orderBy("i")
    changed = F.coalesce((F.lag("code").over(w) != F.col("code")).cast("int"), F.lit(1))
    runs = samples.withColumn("changed", changed).withColumn("seg_id", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = runs.groupBy("recording", "seg_id", "code").agg(F.min("i").alias("low"), F.max("i").alias("high"))
    label = F.when(F.col("code").isin(*positive), 1).when(F.col("code").isin(*negative), 0)
    return out.select("recording", "seg_id", (F.col("low") / fs).alias("start_s"), ((F.col("high") + 1) / fs).alias("end_s"), label.alias("label"), F.col("code").alias("seg_name")).where("label is not null")


def hopping_windows(segments: DataFrame, width: float, stride: float) -> DataFrame:
    """Windows of width seconds every stride seconds inside each segment: all of segments with k (from 0) and t0."""
    most = F.floor((F.col("end_s") - F.col("start_s") - width + 1e-9) / stride).cast("int")
    fits = segments.where(F.col("end_s") - F.col("start_s") + 1e-9 >= width)
    return fits.withColumn("k", F.explode(F.sequence(F.lit(0), most))).withColumn("t0", F.col("start_s") + F.col("k") * F.lit(stride))


def range_join(samples: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """Samples in [t0, t0 + width) of the windows of their recording. Both sides meet in time buckets of one width: a window reaches
    into two, so that no recording is compared with all its windows."""
    bucket = lambda t: F.floor(t / width)
    w = windows.withColumn("bucket", F.explode(F.array(bucket(F.col("t0")), bucket(F.col("t0")) + 1)))
    s = samples.withColumn("bucket", bucket(F.col("t_s")))
    return s.join(w, ["recording", "bucket"]).where((F.col("t_s") >= F.col("t0")) & (F.col("t_s") < F.col("t0") + width)).drop("bucket")


def cut_arrays(recordings: DataFrame, windows: DataFrame, channels: dict[str, float], width: float) -> DataFrame:
    """Windows of several channels at their own rates. recordings: recording and an array a channel; windows: recording, t0. Starts and
    lengths in samples are rounded half to even. whole tells if the window lies in all channels with finite values only; what a
    window would hold is cast to float."""
    joined = windows.join(recordings, "recording")
    ok: Column = F.lit(True)
    out = joined
    for name, fs in sorted(channels.items()):
        first, n = F.rint(F.col("t0") * fs).cast("int"), int(round(width * fs))
        part = F.slice(F.col(name), first + 1, n)
        ok = ok & (first + n <= F.size(name)) & F.forall(part, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        out = out.withColumn(f"{name}_window", part.cast("array<float>"))
    return out.withColumn("whole", ok).drop(*channels)


def finite_edges(samples: DataFrame) -> DataFrame:
    """Samples (recording, i, v) from the first to the last finite value of each recording."""
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    edges = samples.where(finite).groupBy("recording").agg(F.min("i").alias("low"), F.max("i").alias("high"))
    return samples.join(edges, "recording").where((F.col("i") >= F.col("low")) & (F.col("i") <= F.col("high"))).drop("low", "high")


def overlap(samples: DataFrame) -> DataFrame:
    """Samples (recording, channel, t_s) in the time that all channels of the recording cover."""
    spans = samples.groupBy("recording", "channel").agg(F.min("t_s").alias("low"), F.max("t_s").alias("high"))
    shared = spans.groupBy("recording").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    return samples.join(shared, "recording").where((F.col("t_s") >= F.col("low")) & (F.col("t_s") <= F.col("high"))).drop("low", "high")


def clock_check(samples: DataFrame, fs: float, tolerance: float = 0.01) -> DataFrame:
    """Per recording the median time step, and whether it is within tolerance of 1 / fs. Fewer than two samples: not."""
    step = F.col("t_s") - F.lag("t_s").over(Window.partitionBy("recording").orderBy("i"))
    out = samples.withColumn("step", step).groupBy("recording").agg(F.count("*").alias("n"), F.expr("percentile(step, 0.5)").alias("median_step"))
    return out.withColumn("ok", F.coalesce(F.abs(F.col("median_step") - 1 / fs) <= tolerance / fs, F.lit(False)))


def consistent(recordings: DataFrame) -> DataFrame:
    """Per subject whether its recordings (subject, channels: map of name to rate) agree."""
    return recordings.groupBy("subject").agg((F.count_distinct(F.sort_array(F.map_entries("channels"))) == 1).alias("consistent"))


def window_id(subject: Column, segment: Column, t0: Column) -> Column:
    """subject:segment:t0 with one decimal, halves to even."""
    tenths = F.rint(t0 * 10).cast("bigint")
    sign = F.when((tenths < 0), "-").otherwise("")
    return F.concat_ws(":", subject, segment, F.concat(sign, F.floor(F.abs(tenths) / 10).cast("string"), F.lit("."), (F.abs(tenths) % 10).cast("string")))


def manifest(windows: DataFrame, key: str = "recording", label: str = "label") -> DataFrame:
    """Per key, and in all (null key): windows and windows of each class."""
    return windows.rollup(key).agg(F.count("*").alias("n_windows"), F.count_if(F.col(label) == 0).alias("n_0"), F.count_if(F.col(label) == 1).alias("n_1"))
