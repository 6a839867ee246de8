"""The audit's views over a star schema with events, embeddings and labelled documents: see README."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, metrics
from ..operators import windowing

POSITIVE, NEGATIVE = ("purchase", "signup"), ("view", "click")
WIDTH, STRIDE = 432_000.0, 216_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since 2024-01-01 of a timestamp, both taken in the session's zone."""
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, i (from 0 in order of time), t_s, v, code: one recording a user."""
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("recording"), place.cast("bigint").alias("i"), seconds(F.col("ts")).alias("t_s"), F.col("value").alias("v"), F.col("event_type").alias("code"))


def span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment a user: from 0 to the last event, label 1 if more than a fifth of the events are purchases."""
    s = samples(spark, sf_dir)
    return s.groupBy("recording").agg(F.lit(0.0).alias("start_s"), F.max("t_s").alias("end_s"), (5 * F.count_if(F.col("code") == "purchase") > F.count("*")).cast("int").alias("label"))


def ev_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowing.hopping_windows(span_segments(spark, sf_dir), WIDTH, STRIDE)


def window_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples in each hopping window."""
    return windowing.range_join(samples(spark, sf_dir), ev_windows(spark, sf_dir), WIDTH)


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hopping window subject, window_id, y and features; the spread is missing below six samples."""
    w = window_values(spark, sf_dir)
    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("recording", "k").orderBy("i")))
    rows = w.withColumn("step", step).groupBy("recording", "k", "t0").agg(
        F.count("*").alias("n"), F.avg("v").alias("f_mean"), F.when(F.count("*") >= 6, F.stddev_samp("v")).alias("f_sd"), F.expr("percentile(v, 0.5)").alias("f_median"), F.avg("step").alias("f_step"), F.max("v").alias("f_max"),
        (5 * F.count_if(F.col("code") == "purchase") > F.count("*")).cast("int").alias("y"),
    )
    return rows.select(F.col("recording").alias("subject"), F.concat_ws(":", "recording", "k").alias("window_id"), "k", "t0", "y", "n", "f_mean", "f_sd", "f_median", "f_step", "f_max")


FEATURES = ("f_mean", "f_sd", "f_median", "f_step", "f_max")


def sig_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with an array channel: twenty subjects, 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("S"), (F.col("vec_id") % 20).cast("string")).alias("subject"), F.concat(F.lit("seg"), F.col("label").cast("string")).alias("seg_name"), (F.col("vec_id") * 30.0).alias("t0"),
        F.format_string("S%d:seg%d:%08d", F.col("vec_id") % 20, F.col("label"), F.col("vec_id")).alias("window_id"), (F.col("label") >= 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"), "vec_id",
    )


def scored(spark: SparkSession, sf_dir: str, surrogate: bool = False) -> DataFrame:
    """Scored rows, of the real condition or of a surrogate one."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(q, "doc_id")
    a, b = (-((F.col("doc_id") * 7919) % 97) / 97.0, -((F.col("doc_id") * 104729) % 89) / 89.0) if surrogate else (-(F.col("n_chars") % 97) / 97.0, -(F.col("n_chars") % 89) / 89.0)
    rows = j.select(F.col("source").alias("subject"), F.col("doc_id").cast("string").alias("window_id"), F.col("quality").alias("y"), a.alias("logprob_a"), b.alias("logprob_b"), (F.col("doc_id") % 50 == 0).alias("failure"))
    return rows.withColumn("yhat", F.when(~F.col("failure"), metrics.argmax_label(F.col("logprob_a"), F.col("logprob_b"))))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inter-beat intervals of a recording, from its values: ibi in ms."""
    s = samples(spark, sf_dir)
    return s.groupBy("recording").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda r: 200.0 + 10.0 * r["v"]).alias("ibi"))


def prompt_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig_windows(spark, sf_dir).select("window_id", arrays.bin_mean(F.col("x"), 8).alias("x"))
