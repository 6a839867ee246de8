"""Readers of recordings, feature matrices, cells and items, and sinks with manifests."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import bits
from ..operators import windowing
from ..schemas import feature_columns, require_columns

#: Rate of the channel sensor by subject: some wore one of 100 Hz (fixed values; the caller names them).
OTHER_RATE = 102.5


def zip_members(spark: SparkSession, path: str, pattern: str = r"(?:^|/)S(\d+)/S\1\.") -> DataFrame:
    """(path, subject, member) of the subjects in zip archives, in numeric order of the subject."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                for name in zipfile.ZipFile(io.BytesIO(content)).namelist():
                    if m := re.search(pattern, name):
                        rows.append((p, f"S{m[1]}", name))
            yield pd.DataFrame(rows, columns=["path", "subject", "member"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, subject string, member string").orderBy(F.substring("subject", 2, 9).cast("int"))


def npz_windows(spark: SparkSession, path: str) -> DataFrame:
    """Window archives (arrays y, t0, seg_name and one matrix a channel) as a row a window: file, k, t0, y, seg_name, channels. Pickled
    content is refused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                names = [n for n in z.files if z[n].ndim == 2]
                yield pd.DataFrame([(p, k, float(z["t0"][k]), int(z["y"][k]), str(z["seg_name"][k]), {n: z[n][k].astype(float).tolist() for n in names}) for k in range(len(z["y"]))], columns=["file", "k", "t0", "y", "seg_name", "channels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, k int, t0 double, y int, seg_name string, channels map<string,array<double>>")


def trial_csv(spark: SparkSession, path: str, positive: tuple[str, ...], negative: tuple[str, ...], slow: tuple[str, ...] = ()) -> DataFrame:
    """Wide CSVs `<subject>/<file>` with a column `Trial k:Nback` a trial as samples: subject, trial, label, fs, i, v. Trials of other
    codes are dropped; subjects in slow have 100 Hz."""
    wide = spark.read.option("header", True).option("inferSchema", False).csv(path)
    trials = [c for c in wide.columns if c.startswith("Trial")]
    rows = wide.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("subject"), F.monotonically_increasing_id().alias("line"), F.explode(F.create_map(*(x for c in trials for x in (F.lit(c), F.col(f"`{c}`").cast("double"))))).alias("trial", "v"))
    code = F.regexp_extract("trial", r":(\d+)", 1)
    label = F.when(code.isin(*positive), 1).when(code.isin(*negative), 0)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("subject", "trial").orderBy("line")) - 1
    return rows.select("subject", "trial", label.alias("label"), F.when(F.col("subject").isin(*slow), 100.0).otherwise(OTHER_RATE).alias("fs"), place.cast("bigint").alias("i"), "v").where("label is not null")


def session_csv(spark: SparkSession, path: str, fs: dict[str, float]) -> DataFrame:
    """`<subject>/<session>/empatica_<channel>.csv` (value, time) as samples of complete subjects, trimmed to the time that all channels
    of a session cover: subject, recording, session, channel, t_s, v. Raises where a clock does not match its nominal rate."""
    raw = spark.read.schema("value double, time double").option("header", True).csv(path)
    part = lambda i: F.element_at(F.split(F.input_file_name(), "/"), -i)
    s = raw.select(part(3).alias("subject"), part(2).alias("session"), F.regexp_extract(part(1), r"_(\w+)\.csv", 1).alias("channel"), F.col("time").alias("t_s"), F.col("value").alias("v"))
    complete = s.groupBy("subject").agg(F.count_distinct("session", "channel").alias("files")).where(F.col("files") == 2 * len(fs)).select("subject")
    s = s.join(complete, "subject").withColumn("recording", F.concat_ws("/", "subject", "session"))
    for channel, rate in fs.items():
        one = s.where(F.col("channel") == channel).withColumn("i", F.col("t_s"))
        bad = windowing.clock_check(one, rate).where("not ok").take(1)
        if bad:
            raise ValueError(f"{bad[0]['recording']}: clock of {channel} does not match nominal {rate} Hz")
    return windowing.overlap(s)


def feature_matrix(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A parquet feature matrix with its columns checked; NaN becomes null."""
    df = spark.read.parquet(path)
    columns = feature_columns(dataset)
    require_columns(df, ["subject", "y", *columns])
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in columns})


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Result documents {"cells": [...]} as a row a cell, with their file."""
    return spark.read.option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.explode("cells").alias("c")).select("file", "c.*")


def items(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """JSON items (instruction, input or question, output) with body; raises if there are not as many as expected."""
    df = spark.read.option("multiLine", True).json(path)
    for c in ("input", "question"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} items, not {expected}")
    return df.withColumn("body", F.coalesce(F.nullif("input", F.lit("")), "question"))


def content_hash(df: DataFrame) -> int:
    """A hash of a table's rows in any order: part files are not byte-stable, their content is."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return int(df.agg(F.sum(bits(row).cast("decimal(38,0)")).alias("h")).first()["h"] or 0)


def write_windows(windows: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "subject")) -> None:
    """Windows by dataset and subject; an existing table is not overwritten."""
    windows.write.mode("errorifexists").partitionBy(*keys).parquet(path)


def write_matrix(matrix: DataFrame, path: str, features: list[str]) -> dict:
    """A feature matrix and its manifest: rows, subjects, share of missing values a feature, rows without any value."""
    matrix.write.mode("errorifexists").parquet(path)
    gaps = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features]
    empty = F.count_if(F.greatest(*(F.col(c).isNotNull().cast("int") for c in features), F.lit(0)) == 0)
    m = matrix.sparkSession.read.parquet(path).agg(F.count("*").alias("n_rows"), F.count_distinct("subject").alias("n_subjects"), empty.alias("n_empty"), *gaps).first().asDict()
    return {"n_rows": m["n_rows"], "n_subjects": m["n_subjects"], "n_empty": m["n_empty"], "nan_rate": {c: m[c] for c in features}}


def append_missing(cells_: DataFrame, path: str, keys: list[str]) -> int:
    """Append the cells whose keys the table at path does not have yet (resume); returns how many."""
    spark = cells_.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    todo = cells_.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if there else cells_
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n


def manifest(config: dict) -> dict:
    """Provenance of a run: time, configuration and its hash, versions."""
    import hashlib
    import platform
    from datetime import UTC, datetime

    import pyspark

    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return {"created_utc": datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ"), "config": config, "config_sha256": hashlib.sha256(text.encode()).hexdigest(), "versions": {"pyspark": pyspark.__version__, "numpy": np.__version__, "python": platform.python_version()}}
