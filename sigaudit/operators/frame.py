"""The feature frame: every window's features by its dataset's plan, in one pass over channels of different rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import detectors, dsp
from ..schemas import FAMILIES, PLAN, feature_columns

#: What a family is taken from: the sensor that each dataset has for it, with its channel and its rate in Hz (fixed values).
SENSORS = {
    "wesad": {"hrv": ("heart", "ecg", 700.0), "eda": ("skin", "eda", 700.0), "resp": ("breath", "resp", 700.0)},
    "cogwear": {"hrv": ("pulse", "bvp", 64.0), "eda": ("skin", "eda", 4.0)},
    "maus": {"hrv": ("pulse", "ppg", 102.5)},
}
KERNELS: dict[str, Callable[[np.ndarray, float], dict[str, float | None]]] = {"heart": detectors.heart, "pulse": detectors.pulse, "skin": dsp.skin, "breath": detectors.breaths}
#: Bytes of windows that a Python worker gets at a time.
BATCH_ROWS = 256


def features_of(kernel: str, family: str, x: np.ndarray, fs: float) -> list[float | None]:
    """A family's features of one window in plan order. Missing where the kernel can't tell: no window, samples that are missing or not
    finite, too few of them, or a value that is no number."""
    names = FAMILIES[family]
    if len(x) == 0 or not np.isfinite(x).all():
        return [None] * len(names)
    try:
        found = KERNELS[kernel](x, fs)
    except (ValueError, IndexError, ZeroDivisionError):
        return [None] * len(names)
    return [float(v) if (v := found.get(n)) is not None and np.isfinite(v) else None for n in names]


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The arrays of a list column, without a Python object a sample; a null one is empty, a null sample is not a number."""
    values, at = column.values, column.offsets.to_numpy()
    flat = values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    for i, there in enumerate(column.is_valid().to_pylist()):
        yield flat[at[i] : at[i + 1]] if there else flat[:0]


def build_feature_frame(windows: DataFrame, dataset: str, rates: dict[str, float | Column] | None = None, ids: list[str] | None = None) -> DataFrame:
    """The ids of windows and, in plan order, the features of the dataset's families.

    windows has a column `channels`, a map of a channel's name to its samples; all other columns are ids unless ids names them. rates gives
    a channel another rate than the dataset's usual one, as a number or a column where recordings differ. A window without a channel, or
    with one that a family can't be told from, has that family's features missing. Rows are handled one by one: nothing is shuffled. Raises
    for a dataset without a plan and for ids that clash with the plan's columns.
    """
    if dataset not in PLAN:
        raise ValueError(f"no plan for dataset {dataset}")
    plan, columns = PLAN[dataset], feature_columns(dataset)
    ids = [c for c in windows.columns if c != "channels"] if ids is None else ids
    if clash := sorted(set(ids) & set(columns)):
        raise ValueError(f"ids named as features: {', '.join(clash)}")
    given = rates or {}
    inputs = []
    for i, family in enumerate(plan):
        _, channel, usual = SENSORS[dataset][family]
        rate = given.get(channel, usual)
        inputs += [F.try_element_at("channels", F.lit(channel)).cast("array<double>").alias(f"_x{i}"), (rate if isinstance(rate, Column) else F.lit(float(rate))).cast("double").alias(f"_fs{i}")]
    kernels = [(SENSORS[dataset][family][0], family) for family in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(lo, BATCH_ROWS)
                out: list[list[float | None]] = [[] for _ in columns]
                at = 0
                for i, (kernel, family) in enumerate(kernels):
                    x, fs = part.column(len(ids) + 2 * i), part.column(len(ids) + 2 * i + 1).to_pylist()
                    width = len(FAMILIES[family])
                    for window, rate in zip(_rows(x), fs, strict=True):
                        values = features_of(kernel, family, window, rate) if rate else [None] * width
                        for j, v in enumerate(values):
                            out[at + j].append(v)
                    at += width
                yield pa.RecordBatch.from_arrays([*part.columns[: len(ids)], *(pa.array(c, pa.float64()) for c in out)], [*ids, *columns])

    schema = StructType([*(windows.schema[c] for c in ids), *(StructField(c, DoubleType()) for c in columns)])
    return windows.select(*ids, *inputs).mapInArrow(run, schema)


def missing_report(frame: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n (windows), missing (share of them); the null feature: share of all values missing, and empty, windows without any."""
    any_ = F.greatest(*(F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    one = frame.agg(F.count("*").alias("n"), F.count_if(any_ == 0).alias("empty"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    total = sum((F.col(c) for c in columns), F.lit(0))
    parts = [F.struct(F.lit(c).alias("feature"), (F.col(c) / F.col("n")).alias("missing"), F.lit(None).cast("bigint").alias("empty")) for c in columns]
    whole = F.struct(F.lit(None).cast("string").alias("feature"), (total / (F.col("n") * len(columns))).alias("missing"), F.col("empty").alias("empty"))
    return one.select("n", F.explode(F.array(*parts, whole)).alias("r")).select("r.feature", "n", "r.missing", "r.empty")
