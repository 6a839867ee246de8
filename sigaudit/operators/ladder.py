"""The ladder of surrogates over windows of several channels: one dispatcher, tables on disk by dataset, rung and subject, features of them.

Windows have subject, window_id, y and `channels`, a map of a channel's name to its samples; recordings may differ in rate, so that windows
of one channel may differ in length. Whatever a rung puts in a window keeps that window's lengths.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import bits, draw
from ..schemas import NULL_RUNGS, RUNGS, feature_columns
from . import frame, publish, surrogates

KEYS = ("dataset", "rung", "subject")


class ShapeError(ValueError):
    """A surrogate's channels or lengths are not those of its window."""


def channel_moments(windows: DataFrame) -> DataFrame:
    """channel, n, mean, var (population) over all samples of all windows, from sums a window."""
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda a, v: a + f(v))
    sums = windows.select(F.explode("channels").alias("channel", "x")).select("channel", F.size("x").alias("n"), total(lambda v: v).alias("s"), total(lambda v: v * v).alias("q"))
    m = F.col("s") / F.col("n")
    return sums.groupBy("channel").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select("channel", "n", m.alias("mean"), F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)).alias("var"))


def donors(windows: DataFrame, seed: int, same_class: bool, salt: int = 1 << 16) -> DataFrame:
    """(window_id, donor): for each window one of another subject (and, with same_class, of its class), drawn evenly. Windows are numbered
    subject by subject; a draw over all but the own subject's is shifted past those, so that no pair of rows is formed.

    Within a subject windows are numbered inside salt-th parts of their ids' hashes, so that no task orders all windows of a large subject.
    Raises where a window has no possible donor."""
    keys = ["y"] if same_class else []
    rows = windows.select("subject", "window_id", *keys).withColumn("part", draw(F.lit(salt), "part", F.col("window_id")))
    sizes = rows.groupBy(*keys, "subject", "part").agg(F.count("*").alias("rows"))
    own = sizes.groupBy(*keys, "subject").agg(F.sum("rows").alias("own"))
    lonely = own.groupBy(*keys).agg(F.count("*").alias("subjects")).where("subjects < 2").head()
    if lonely:
        raise ValueError("no window of another subject" + (f" in class {lonely['y']}" if same_class else ""))
    blocks = own.withColumn("a", F.coalesce(F.sum("own").over(Window.partitionBy(*keys).orderBy("subject").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("own").over(Window.partitionBy(*keys)))
    starts = sizes.withColumn("first", F.coalesce(F.sum("rows").over(Window.partitionBy(*keys, "subject").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    place = F.row_number().over(Window.partitionBy(*keys, "subject", "part").orderBy("window_id")) - 1
    placed = rows.withColumn("r", place).join(starts, [*keys, "subject", "part"]).join(blocks, [*keys, "subject"]).withColumn("at", F.col("a") + F.col("first") + F.col("r"))
    d = draw(F.col("all") - F.col("own"), seed, F.col("window_id"))
    wanted = placed.select(*keys, "window_id", F.when(d < F.col("a"), d).otherwise(d + F.col("own")).alias("at"))
    return wanted.join(placed.select(*keys, "at", F.col("window_id").alias("donor")), [*keys, "at"]).select("window_id", "donor")


def _resampled(x, n):
    """The samples of x at n evenly spaced places, by linear interpolation; x itself if it has n."""
    size = F.size(x)
    at = lambda j: j * (size - 1) / F.greatest(n - 1, F.lit(1))
    low = lambda j: F.floor(at(j)).cast("int")
    one = lambda j: F.get(x, low(j)) + (at(j) - low(j)) * (F.get(x, F.least(low(j) + 1, size - 1)) - F.get(x, low(j)))
    return F.when(size == n, x).when(n < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))


def from_donors(windows: DataFrame, pairs: DataFrame) -> DataFrame:
    """windows with all channels of their donor, each at the length of the window's own; ids and labels stay. A channel that the donor
    does not have is missing, and so caught by checked()."""
    given = windows.select(F.col("window_id").alias("donor"), F.col("channels").alias("given"))
    joined = windows.join(pairs, "window_id").join(given, "donor")
    moved = F.transform_values("channels", lambda k, x: _resampled(F.try_element_at("given", k), F.size(x)))
    return joined.withColumn("channels", moved).drop("given", "donor").select(*windows.columns)


def _noise(windows: DataFrame, rung: str, moments: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """Gaussian or spectrum-preserving channels, from a stream a window and channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("channels")
            ids, out = batch.column(batch.schema.get_field_index("window_id")).to_pylist(), []
            for key, channels in zip(ids, batch.column(at).to_pylist(), strict=True):
                made = []
                for name, x in channels or []:
                    rng, n = surrogates._row_rng(seed, f"{key}/{name}"), len(x)
                    if rung == "gaussian":
                        mean, var = moments[name]
                        made.append((name, rng.normal(mean, np.sqrt(var), n).tolist()))
                    else:
                        # a series of fewer than four samples has no spectrum to keep: it is dealt out anew
                        row = np.array(x, float)[None]
                        start = rng.permutation(row[0])[None]
                        made.append((name, (surrogates.iaaft_rows(row, start)[0] if n >= 4 else start[0]).tolist()))
                out.append(None if channels is None else made)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return windows.mapInArrow(run, windows.schema)


def portable_noise(windows: DataFrame, moments: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """Gaussian channels from draws that are the same on any engine: two md5 draws a sample, made normal by their polar angle."""
    mean = F.create_map(*(F.lit(x) for name, (m, _) in moments.items() for x in (name, float(m)))) if moments else F.create_map().cast("map<string,double>")
    spread = F.create_map(*(F.lit(x) for name, (_, v) in moments.items() for x in (name, float(np.sqrt(v))))) if moments else F.create_map().cast("map<string,double>")
    share = lambda k, i, which: (bits(seed, F.col("window_id"), k, i, which) + 0.5) / 4294967296.0
    normal = lambda k, i: F.sqrt(-2.0 * F.log(share(k, i, "r"))) * F.cos(F.lit(2 * np.pi) * share(k, i, "a"))
    made = F.transform_values("channels", lambda k, x: F.transform(x, lambda v, i: F.try_element_at(mean, k) + F.try_element_at(spread, k) * normal(k, i)))
    return windows.withColumn("channels", made)


def checked(made: DataFrame, windows: DataFrame) -> DataFrame:
    """made, with a job that fails at the first row whose channels, lengths or samples are not fit to stand for its window's: other
    channels, another length, a sample that is missing or not finite."""
    shape = lambda c: F.map_from_entries(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), F.size(e["value"]).alias("n")))))
    entries = lambda c: F.array_sort(F.map_entries(shape(c)))
    finite = F.forall(F.map_values("channels"), lambda x: x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    own = windows.select("window_id", entries("channels").alias("_own"))
    bad = ~F.coalesce((entries("channels") == F.col("_own")) & finite, F.lit(False))
    joined = made.join(own, "window_id")
    guard = F.when(bad, F.raise_error(F.concat(F.lit("shape of surrogate differs: "), F.col("window_id"))).cast("boolean")).otherwise(F.lit(True))
    return joined.where(guard).select(*made.columns)


def apply_surrogate(windows: DataFrame, rung: str, seed: int, portable: bool = False) -> DataFrame | None:
    """The windows with the channels of a rung, or None for `deleted`, which has no signal. Every rung keeps ids, labels, channels and
    lengths; the result is checked for that as it is computed. An empty table gives an empty one. portable: noise by portable_noise() and
    not by a numpy stream. Raises for an unknown rung."""
    if rung not in RUNGS:
        raise ValueError(f"unknown rung {rung}")
    if rung == "deleted":
        return None
    windows = windows.withColumn("channels", F.col("channels").cast("map<string,array<double>>"))
    if rung.startswith("subject_perm"):
        if windows.isEmpty():
            return windows
        return checked(from_donors(windows, donors(windows, seed, rung.endswith("preserved"))), windows)
    # one row a channel of the dataset's sensors
    moments = {r["channel"]: (r["mean"], r["var"]) for r in channel_moments(windows).collect()}
    if rung == "flatline":
        means = F.create_map(*(F.lit(v) for name, (mean, _) in moments.items() for v in (name, mean))) if moments else F.create_map().cast("map<string,double>")
        return windows.withColumn("channels", F.transform_values("channels", lambda k, x: F.array_repeat(F.try_element_at(means, k), F.size(x))))
    if rung == "gaussian" and portable:
        return checked(portable_noise(windows, moments, seed), windows)
    return checked(_noise(windows, rung, moments, seed), windows)


def materialise(windows: DataFrame, dataset: str, path: str, seed: int, rungs: tuple[str, ...] = RUNGS, real: bool = True) -> dict[str, int]:
    """Tables of windows under path by dataset, rung and subject, with the real ones as rung `real`; returns windows a rung. A rung that is
    there already is left as it is (resume); one is published whole or not at all. `deleted` has a note in place of a table."""
    spark, done = windows.sparkSession, {}
    for rung in (*(("real",) if real else ()), *rungs):
        place = f"{path}/dataset={dataset}/rung={rung}"
        if publish.exists(spark, place):
            done[rung] = 0 if rung == "deleted" else spark.read.parquet(place).count()
            continue
        made = windows if rung == "real" else apply_surrogate(windows, rung, seed)
        if made is None:
            publish.publish_text(spark, json.dumps({"dataset": dataset, "rung": rung, "windows": 0, "signal": None}), place, "none.json")
            done[rung] = 0
            continue
        publish.publish(made.repartition("subject"), place, partition_by=("subject",))
        done[rung] = spark.read.parquet(place).count()
    return done


def read(spark: SparkSession, path: str, dataset: str, rung: str) -> DataFrame:
    """The windows of a rung as they were written, subject as a string."""
    df = spark.read.parquet(f"{path}/dataset={dataset}/rung={rung}")
    return df.withColumn("subject", F.col("subject").cast("string"))


def features_of_rungs(spark: SparkSession, path: str, dataset: str, target: str, rates: dict | None = None, rungs: tuple[str, ...] = ("real", *RUNGS)) -> list[dict]:
    """The feature frame of every rung under path, published under target with a manifest beside it: windows, subjects, whether the rung is
    a null one, share of missing values, and the content's hash. Returns the manifests. Rungs that are there are left as they are."""
    from ..sources.readers import content_hash

    out = []
    for rung in rungs:
        place, note = f"{target}/{dataset}/{rung}", f"{target}/{dataset}/{rung}.manifest"
        if publish.exists(spark, note):
            out.append(json.loads(publish.read_text(spark, note, "manifest.json")))
            continue
        m: dict = {"dataset": dataset, "rung": rung, "is_null": rung in NULL_RUNGS, "n_windows": 0, "n_subjects": 0, "nan_rate": None, "sha": None}
        if rung != "deleted":
            columns = feature_columns(dataset)
            if not publish.exists(spark, place):
                publish.publish(frame.build_feature_frame(read(spark, path, dataset, rung), dataset, rates), place)
            made = spark.read.parquet(place)
            gaps = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)) / (F.count("*") * len(columns))
            m |= made.agg(F.count("*").alias("n_windows"), F.count_distinct("subject").alias("n_subjects"), gaps.alias("nan_rate")).head().asDict()
            m["sha"] = f"{content_hash(made):x}"
        publish.publish_text(spark, json.dumps(m, sort_keys=True), note, "manifest.json")
        out.append(m)
    return out
