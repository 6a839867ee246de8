"""The segment-window transform on streams: batch hopping windows inside labelled segments, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import windowing


def cut_segments(segments: DataFrame, width: float, stride: float) -> DataStreamWriter:
    """A stream of closed segments (recording, start_s, end_s, label) as one of their windows: stateless, as a window never crosses a
    segment."""
    return windowing.hopping_windows(segments, width, stride).writeStream.outputMode("append")


def hopping_statistics(samples: DataFrame, width: str, stride: str, late: str) -> DataFrame:
    """A stream of samples (recording, ts, v) as count, mean and spread of epoch-aligned hopping windows; samples later than `late` behind
    the newest are dropped with the state of their windows."""
    w = F.window("ts", width, stride)
    return samples.withWatermark("ts", late).groupBy("recording", w.alias("w")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).select("recording", F.col("w.start").alias("start"), "n", "mean", "sd")
