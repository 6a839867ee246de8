"""Exact ranks and order statistics of columns without one task that sees all values, and with any one subject's values left out.

Values are counted per subject, and dealt to BINS bins of about as many values each, whose borders are approximate quantiles. Ranks
are those of a bin (from BINS numbers a column, which the driver holds) and those inside a bin; any borders give the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, save

BINS = 512


@dataclass
class Binned:
    """counts: (key, f, v, bin, c), a row a subject and value; before: values in lower bins, a column's BINS + 1 numbers."""

    counts: DataFrame
    before: dict[str, np.ndarray]


def melted(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, f, v): the values of all columns one below the other, missing ones left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in columns)))
    return rows.select(F.col(key).alias("key"), pairs.alias("p")).select("key", "p.f", "p.v").where("v is not null and not isnan(v)")


def searched(sorted_: dict[str, np.ndarray], side: str):
    """An Arrow function (column, number): how many of the column's sorted numbers are below (left) or not above (right) it."""

    @F.pandas_udf("int")
    def place(f: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(f), np.int32)
        for name in f.unique():
            own = (f == name).to_numpy()
            out[own] = np.searchsorted(sorted_[name], v.to_numpy()[own], side)
        return pd.Series(out)

    return place


def binned(rows: DataFrame, columns: list[str], key: str, bins: int = BINS) -> Binned:
    spark = rows.sparkSession
    counts, at = save(melted(rows, columns, key).groupBy("key", "f", "v").agg(F.count("*").alias("c")))
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    borders = {r["f"]: np.unique(r["q"]) for r in counts.groupBy("f").agg(F.percentile_approx("v", shares, 20 * bins).alias("q")).collect()}
    placed, _ = save(counts.withColumn("bin", searched(borders, "left")("f", "v")))
    drop(spark, at)
    before = {f: np.zeros(len(b) + 2, np.int64) for f, b in borders.items()}
    for r in placed.groupBy("f", "bin").agg(F.sum("c").alias("c")).collect():
        before[r["f"]][r["bin"] + 1] = r["c"]
    return Binned(placed, {f: np.cumsum(x) for f, x in before.items()})


def _with_low(rows: DataFrame, b: Binned) -> DataFrame:
    """rows (f, bin) with low and high: the numbers of values in lower bins, and up to the bin's end. A table of BINS rows a column."""
    bounds = [(f, i, int(x[i]), int(x[i + 1])) for f, x in b.before.items() for i in range(len(x) - 1)]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, "f string, bin int, low bigint, high bigint")), ["f", "bin"])


def _total(b: Binned, f: str = "f") -> Column:
    """The number of values of a column of all subjects."""
    out = F.lit(0).cast("bigint")
    for name, x in b.before.items():
        out = F.when(F.col(f) == name, F.lit(int(x[-1]))).otherwise(out)
    return out


def _own_before(counts: DataFrame) -> DataFrame:
    """(key, f, bin, own, own_before): a subject's values in a bin and in the lower ones."""
    own = counts.groupBy("key", "f", "bin").agg(F.sum("c").alias("own"))
    upto = Window.partitionBy("key", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.withColumn("own_before", F.sum("own").over(upto) - F.col("own"))


def _inside(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts with upto: the sum of c over the values of the keys' group that are at most v."""
    return counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def left_out_shares(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, f, v, share): of the values of all other subjects the share that is at most v; missing if there are none."""
    b = binned(rows, columns, key)
    every = _inside(b.counts.groupBy("f", "bin", "v").agg(F.sum("c").alias("c")), ["f", "bin"])
    every = _with_low(every, b).select("f", "bin", "v", (F.col("upto") + F.col("low")).alias("at_most"))
    own = _inside(b.counts, ["key", "f", "bin"]).join(_own_before(b.counts), ["key", "f", "bin"])
    sizes = b.counts.groupBy("key", "f").agg(F.sum("c").alias("own_n"))
    both = own.join(every, ["f", "bin", "v"]).join(sizes, ["key", "f"])
    others = _total(b) - F.col("own_n")
    share = (F.col("at_most") - F.col("own_before") - F.col("upto")) / F.nullif(others, F.lit(0))
    return both.select("key", "f", "v", share.alias("share"))


def left_out_medians(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, f, median): the median of all other subjects' values of each column; missing if there are none.

    The value of rank r among the others has one of the ranks r to r + n among all, n of them being the subject's own; which one shows
    when its own values up to there are counted. That is settled first for the bins and then inside the bin found, so that a subject
    meets a value or two and no row meets another subject.
    """
    b = binned(rows, columns, key)
    subjects = rows.select(F.col(key).alias("key")).distinct().withColumn("f", F.explode(F.array(*map(F.lit, columns))))
    sizes = b.counts.groupBy("key", "f").agg(F.sum("c").alias("n"))
    wanted = subjects.join(sizes, ["key", "f"], "left").select("key", "f", F.coalesce("n", F.lit(0)).alias("n"), _total(b).alias("all")).withColumn("others", F.col("all") - F.col("n")).where("others > 0")
    ranks = wanted.select("key", "f", "n", "all", F.explode(F.array_distinct(F.array(F.floor((F.col("others") - 1) / 2), F.floor(F.col("others") / 2)))).alias("k"))

    # bins that may hold the value of rank k (from 0) among the others; of these the first whose last value is beyond it
    of_rank = searched({f: a[1:] for f, a in b.before.items()}, "right")
    tried = ranks.withColumn("bin", F.explode(F.sequence(of_rank("f", "k"), of_rank("f", F.least(F.col("k") + F.col("n"), F.col("all") - 1)))))
    own = b.counts.groupBy("key", "f", "bin").agg(F.sum("c").alias("own"))
    steps = own.unionByName(tried.select("key", "f", "bin").distinct().withColumn("own", F.lit(0).cast("bigint"))).groupBy("key", "f", "bin").agg(F.sum("own").alias("own"))
    upto = Window.partitionBy("key", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("own_upto", F.sum("own").over(upto))
    ends = _with_low(tried.join(steps, ["key", "f", "bin"]), b).where(F.col("high") - F.col("own_upto") > F.col("k"))
    found = ends.groupBy("key", "f", "k").agg(F.min(F.struct("bin", "low", "own", "own_upto")).alias("b")).select("key", "f", "k", "b.*")
    inside, _ = save(found.withColumn("rank", F.col("k") - (F.col("low") - (F.col("own_upto") - F.col("own")))))  # one or two rows a subject and column

    # inside its bin: between two own values (and before the first) the others' rank is the rank among all less a fixed number of own
    # ones, so that each stretch has one rank to look up
    needed = b.counts.join(inside.select("f", "bin").distinct(), ["f", "bin"], "left_semi")
    ordered = _inside(needed.groupBy("f", "bin", "v").agg(F.sum("c").alias("c")), ["f", "bin"])
    own_steps = _inside(needed.join(inside.select("key", "f", "bin").distinct(), ["key", "f", "bin"], "left_semi"), ["key", "f", "bin"])
    stretches = inside.select("key", "f", "bin", "k", "rank", F.lit(0).cast("bigint").alias("j")).unionByName(
        inside.join(own_steps.select("key", "f", "bin", F.col("upto").alias("j")), ["key", "f", "bin"]).select("key", "f", "bin", "k", "rank", "j"))
    # most subjects seek the same few ranks: each is looked up once
    stretches = stretches.withColumn("at", F.col("rank") + F.col("j"))
    values = value_at(ordered, stretches.select("f", "bin", "at").distinct(), max((int(np.diff(x).max()) for x in b.before.values()), default=1))
    marks = stretches.join(values, ["f", "bin", "at"]).select("key", "f", "bin", "v", "k", "j", F.lit(0).cast("bigint").alias("c")).unionByName(
        own_steps.select("key", "f", "bin", "v", F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("j"), "c"))
    passed = marks.withColumn("own_at_most", F.sum("c").over(Window.partitionBy("key", "f", "bin").orderBy("v"))).where("k is not null and own_at_most <= j")
    return passed.groupBy("key", "f", "k").agg(F.min("v").alias("v")).groupBy("key", "f").agg(F.avg("v").alias("median"))


def value_at(ordered: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """wanted (f, bin, at and more) with the value v of ordered (f, bin, v, c, upto) that has the rank at, from 0; ranks beyond the last
    are left out. A value has the ranks upto - c to upto - 1. That interval is cut into dyadic pieces, two at most a power of two up to
    most, the largest bin; a rank lies in one piece of each power. So no row is made for each time that a value occurs."""
    powers = F.sequence(F.lit(0), F.lit(max(0, int(most).bit_length() - 1)))
    size = lambda h: F.pow(F.lit(2.0), h).cast("bigint")
    low, high = lambda h: F.ceil((F.col("upto") - F.col("c")) / size(h)), lambda h: F.floor(F.col("upto") / size(h))
    piece = lambda h, at, odd: F.when((low(h) < high(h)) & (odd % 2 == 1), F.struct(h.alias("h"), at.cast("bigint").alias("piece")))
    pieces = F.filter(F.flatten(F.transform(powers, lambda h: F.array(piece(h, low(h), low(h)), piece(h, high(h) - 1, high(h))))), lambda p: p.isNotNull())
    held = ordered.select("f", "bin", "v", F.explode(pieces).alias("p")).select("f", "bin", "v", "p.h", "p.piece")
    sought = wanted.withColumn("h", F.explode(powers)).withColumn("piece", F.floor(F.col("at") / size(F.col("h"))))
    return sought.join(held, ["f", "bin", "h", "piece"]).drop("h", "piece")
