"""Metrics as aggregate expressions and DataFrame functions. Scored rows have y, yhat (0 or 1), failure, and logprobs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import save
from .rng import draw


def argmax_label(a: Column, b: Column) -> Column:
    """1 if b's log probability is larger, 0 if not (a tie goes to the first label), null if either is missing."""
    return F.when(a.isNull() | b.isNull(), None).when(b > a, 1).otherwise(0)


def confusion(y: str = "y", yhat: str = "yhat") -> list[Column]:
    one = lambda a, b, name: F.count_if((F.col(y) == a) & (F.col(yhat) == b)).alias(name)
    return [one(1, 1, "tp"), one(0, 1, "fp"), one(1, 0, "fn"), one(0, 0, "tn")]


def macro_f1(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    """Mean F1 over the labels that occur in y or yhat; null if there is no row."""
    tp, fp, fn, tn = map(F.col, (tp, fp, fn, tn))
    one = lambda hit: F.when(2 * hit + fp + fn > 0, (2 * hit).cast("double") / (2 * hit + fp + fn))
    f1, f0 = one(tp), one(tn)
    return (F.coalesce(f1, F.lit(0.0)) + F.coalesce(f0, F.lit(0.0))) / F.nullif(f1.isNotNull().cast("int") + f0.isNotNull().cast("int"), F.lit(0))


def balanced_accuracy(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    """Mean recall of both labels; null if y lacks one."""
    tp, fp, fn, tn = map(F.col, (tp, fp, fn, tn))
    return (tp / F.nullif(tp + fn, F.lit(0)) + tn / F.nullif(tn + fp, F.lit(0))) / 2


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("failure") & F.col("yhat").isNotNull())


def macro_f1_rollup(rows: DataFrame, key: str = "subject") -> DataFrame:
    """Macro F1 of each key and of all rows together (null key), in one pass."""
    return usable(rows).rollup(key).agg(F.count("*").alias("n"), *confusion()).select(key, "n", macro_f1().alias("macro_f1"))


def auroc(rows: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Area under the ROC curve per group, ties counting one half; null if a class is absent. Rows of one score count together, so only
    distinct scores are ranked."""
    ties = rows.groupBy(*keys, score).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ties.withColumn("won", F.col("pos") * (below + F.col("neg") / 2.0))
    out = won.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return out.select(*keys, F.col("pos").alias("n_pos"), F.col("neg").alias("n_neg"), (F.col("won") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("auroc"))


def midrank(value: str, keys: list[str]) -> Column:
    """Average rank of ties within the keys."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def spearman(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    ranked = rows.withColumn("ra", midrank(a, keys)).withColumn("rb", midrank(b, keys))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("spearman"))


def margin(a: str = "logprob_a", b: str = "logprob_b") -> Column:
    return F.col(b) - F.col(a)


def sds(real: Column, surrogate: Column, chance: Column) -> Column:
    """(real - surrogate) / (real - chance); raises for a zero denominator."""
    return F.when(real == chance, F.raise_error(F.lit("real equals chance"))).otherwise((real - surrogate) / (real - chance))


def gated_sds(real: Column, surrogate: Column, chance: Column, low: Column) -> Column:
    """Defined only where the real score's lower bound is strictly above chance; never clipped."""
    return F.when((low > chance) & ~F.isnan(low), (real - surrogate) / (real - chance))


def holm(rows: DataFrame, p: str, keys: list[str], order: list[str]) -> DataFrame:
    """rows with p_holm: step-down adjusted within keys. Missing p stay missing and do not count; ties by order."""
    family = rows.withColumn("there", F.col(p).isNotNull())
    w = Window.partitionBy(*keys, "there").orderBy(p, *order)
    m = F.count(p).over(Window.partitionBy(*keys, "there"))
    stepped = family.withColumn("r", F.row_number().over(w)).withColumn("m", m).withColumn("raw", (F.col("m") - F.col("r") + 1) * F.col(p))
    run = F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn("p_holm", F.when(F.col("there"), F.least(F.lit(1.0), run))).drop("there", "r", "m", "raw")


def indexed(stats: DataFrame, key: str = "subject") -> DataFrame:
    """stats (a row a subject) with idx from 0 in order of the key, and n_keys."""
    return stats.withColumn("idx", F.row_number().over(Window.orderBy(key)) - 1).withColumn("n_keys", F.count("*").over(Window.partitionBy()))


def bootstrap_draws(stats: DataFrame, reps: int, seed: int, key: str = "subject") -> DataFrame:
    """Per replicate as many rows of stats (a row a subject) as there are, drawn with replacement: stats with rep."""
    spark = stats.sparkSession
    rows = indexed(stats, key)
    size = rows.agg(F.first("n_keys").alias("n_keys"))
    reps_ = spark.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(size))
    draws = reps_.select("rep", "n_keys", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_keys") - 1)).alias("k"))
    return draws.select("rep", draw(F.col("n_keys"), seed, F.col("rep"), F.col("k")).alias("idx")).join(rows.drop("n_keys"), "idx")


def bootstrap(stats: DataFrame, sums: list[str], reps: int, seed: int, key: str = "subject") -> DataFrame:
    """Cluster bootstrap on sufficient statistics: per replicate the sums over as many keys as there are, drawn with replacement. Work
    grows with replicates times subjects, not rows."""
    return bootstrap_draws(stats, reps, seed, key).groupBy("rep").agg(*(F.sum(c).alias(c) for c in sums))


def pair_wins(rows: DataFrame, score: str, key: str = "subject") -> DataFrame:
    """(s, t, won): how often a positive row of s scores above a negative one of t, ties counting one half. The area under the ROC curve
    of any draw of subjects is a form in these numbers, so a bootstrap never goes back to the rows."""
    pos = rows.where("y = 1").groupBy(F.col(key).alias("s"), score).agg(F.count("*").alias("pos"))
    neg = rows.where("y = 0").groupBy(F.col(key).alias("t"), score).agg(F.count("*").alias("neg"))
    each = neg.select("t").distinct()
    events = pos.crossJoin(F.broadcast(each)).withColumn("neg", F.lit(0).cast("bigint")).unionByName(neg.withColumn("s", F.lit(None).cast("string")).withColumn("pos", F.lit(0).cast("bigint")))
    at_most, ties = F.sum("neg").over(Window.partitionBy("t").orderBy(score)), F.sum("neg").over(Window.partitionBy("t", score))
    return events.withColumn("won", F.col("pos") * (at_most - ties / 2.0)).where("s is not null").groupBy("s", "t").agg(F.sum("won").alias("won"))


def auroc_bootstrap(rows: DataFrame, score: str, reps: int, seed: int, key: str = "subject") -> DataFrame:
    """(rep, auroc) of subjects drawn with replacement; null where a draw lacks a class."""
    stats = rows.groupBy(key).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    drawn = bootstrap_draws(stats, reps, seed, key)
    times = drawn.groupBy("rep", key).agg(F.count("*").alias("c"), F.first("pos").alias("pos"), F.first("neg").alias("neg"))
    sizes = times.groupBy("rep").agg(F.sum(F.col("c") * F.col("pos")).alias("p"), F.sum(F.col("c") * F.col("neg")).alias("n"))
    a = times.select("rep", F.col(key).alias("s"), F.col("c").alias("cs"))
    b = times.select("rep", F.col(key).alias("t"), F.col("c").alias("ct"))
    won = a.join(pair_wins(rows, score, key), "s").join(b, ["rep", "t"]).groupBy("rep").agg(F.sum(F.col("cs") * F.col("ct") * F.col("won")).alias("w"))
    return sizes.join(won, "rep", "left").select("rep", (F.col("w") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auroc"))


def interval(reps: DataFrame, value: Column, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """ci_lo, ci_hi: linearly interpolated quantiles of a value over replicates (of each key)."""
    v = reps.select(*(keys or []), value.alias("v"))
    return v.groupBy(*(keys or [])).agg(F.expr(f"percentile(v, {alpha / 2})").alias("ci_lo"), F.expr(f"percentile(v, {1 - alpha / 2})").alias("ci_hi"), F.count("v").alias("reps"))


#: Draws are made for so many replicates and places at a time, and subjects are met in blocks of as many.
REP_BLOCK, PLACE_BLOCK = 50, 4096


def _draw_bits(keys: Iterable[str]) -> np.ndarray:
    """The draws of rng.bits for keys whose parts are joined already."""
    return np.frombuffer(b"".join(hashlib.md5(k.encode()).digest()[:4] for k in keys), ">u4")


def _tasks(rows: DataFrame) -> int:
    """Tasks for rows that are few and take long, which Spark would join by their bytes."""
    return 4 * rows.sparkSession.sparkContext.defaultParallelism


def _drawn_places(sizes: DataFrame, reps: int, seed: int) -> DataFrame:
    """(n_keys, block, first, places): of every replicate from first on, the draws that fall into a block of places, as numbers that tell
    replicate and place. sizes: n_keys, distinct. A draw depends on n_keys alone, so that cells of one size share it."""
    units = sizes.select("n_keys", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_keys") - 1, F.lit(PLACE_BLOCK).cast("bigint"))).alias("k"))
    units = units.select("n_keys", "k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(REP_BLOCK))).alias("first"))
    units = units.repartition(_tasks(sizes))

    def draws(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, low, first in zip(frame["n_keys"].tolist(), frame["k"].tolist(), frame["first"].tolist(), strict=True):
                places = range(low, min(n, low + PLACE_BLOCK))
                inside = np.arange(min(reps - first, REP_BLOCK)).repeat(len(places))
                at = _draw_bits(f"{seed}:{first + r}:{k}" for r in range(min(reps - first, REP_BLOCK)) for k in places) % n
                block, code = at // PLACE_BLOCK, (inside * PLACE_BLOCK + at % PLACE_BLOCK).astype(np.uint32)
                order = np.argsort(block, kind="stable")
                found, start = np.unique(block[order], return_index=True)
                parts = [c.tobytes() for c in np.split(code[order], start[1:])]
                yield pd.DataFrame({"n_keys": n, "block": found.astype(np.int64), "first": first, "places": parts})

    return units.mapInPandas(draws, "n_keys bigint, block bigint, first int, places binary")


def bootstrap_by(stats: DataFrame, keys: list[str], sums: list[str], reps: int, seed: int, key: str = "subject") -> DataFrame:
    """(keys, rep, sums): the cluster bootstrap of every cell (keys), whose subjects are numbered in their order. Draws are dealt to blocks
    of PLACE_BLOCK subjects, where the counts of all cells meet them as one matrix; a block's size does not grow with the tables."""
    order, whole = Window.partitionBy(*keys).orderBy(key), Window.partitionBy(*keys)
    numbers = stats.select(*keys, key, *sums).withColumn("idx", (F.row_number().over(order) - 1).cast("bigint")).withColumn("n_keys", F.count("*").over(whole))
    rows, _ = save(numbers.drop(key).withColumn("block", F.floor(F.col("idx") / PLACE_BLOCK)))
    places = _drawn_places(rows.select("n_keys").distinct(), reps, seed)
    inside = F.sort_array(F.collect_list(F.struct((F.col("idx") % PLACE_BLOCK).cast("int").alias("at"), *(F.col(c).cast("double").alias(c) for c in sums))))
    held = rows.groupBy("n_keys", "block", *keys).agg(inside.alias("own")).select("n_keys", "block", *keys, "own.at", *(F.col("own")[c].alias(c) for c in sums))

    def met(own: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(drawn):
            return pd.DataFrame({**{k: [] for k in keys}, **{c: [] for c in sums}})
        code = [np.frombuffer(p, np.uint32).astype(np.int64) + first * PLACE_BLOCK for first, p in zip(drawn["first"], drawn["places"], strict=True)]
        times = np.bincount(np.concatenate(code), minlength=reps * PLACE_BLOCK).reshape(reps, PLACE_BLOCK).astype(float)
        out = {k: own[k] for k in keys}
        for c in sums:
            matrix = np.zeros((PLACE_BLOCK, len(own)))
            for j, (at, values) in enumerate(zip(own["at"], own[c], strict=True)):
                matrix[at, j] = [0 if v is None else v for v in values]
            out[c] = list((times @ matrix).T)
        return pd.DataFrame(out)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    kind = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{c}` array<double>" for c in sums])
    parts = held.groupBy("n_keys", "block").cogroup(places.groupBy("n_keys", "block")).applyInPandas(met, kind)
    each = parts.select(*keys, F.posexplode(F.arrays_zip(*(F.col(c) for c in sums))).alias("rep", "s")).select(*keys, "rep", *(F.col("s")[c].alias(c) for c in sums))
    whole_number = lambda c: types[c] in ("bigint", "int")
    drawn, _ = save(each.groupBy(*keys, "rep").agg(*((F.sum(c).cast("bigint") if whole_number(c) else F.sum(c)).alias(c) for c in sums)))
    return drawn


def hypergeometric_draws(n: int, ones: int, picked: int, u: np.ndarray) -> np.ndarray:
    """How many of ones among n are among picked drawn without replacement, by the inverse distribution at each u."""
    low, high = max(0, ones + picked - n), min(ones, picked)
    t = np.arange(low + 1, high + 1, dtype=float)
    steps = np.log((ones - t + 1) * (picked - t + 1) / (t * (n - ones - picked + t)))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    share = np.cumsum(np.exp(weight - weight.max()))
    return low + np.minimum(np.searchsorted(share / share[-1], u, "left"), high - low)


def matched_floor(counts: DataFrame, keys: list[str], reps: int, seed: int, key: str = "subject") -> DataFrame:
    """(keys, floor_mean, floor_p95) of macro F1 with the labels shuffled within each subject and the predictions fixed.

    counts: tp, fp, fn, tn a subject. A shuffle changes a subject's counts alone, and those by the hypergeometric law, so that replicates
    are drawn from the counts and never from rows.
    """

    names = ["tp", "fp", "fn", "tn"]
    sharing = counts.withColumn("who", F.col(key).cast("string")).repartition(_tasks(counts), "who").groupBy("who").agg(F.collect_list(F.struct(*keys, *(F.col(c).cast("bigint").alias(c) for c in names))).alias("cells"))
    cells = F.transform("cells", lambda c: F.struct(*(c[k].alias(k) for k in keys)))

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sums over a task's subjects: a row a cell, whose hits are an array over replicates."""
        hits: dict[tuple, np.ndarray] = {}
        fixed: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for who, own, *numbers in zip(frame["who"], frame["cells"], *(frame[c] for c in names), strict=True):
                u = (_draw_bits(f"{seed}:{r}:{who}" for r in range(reps)) + 0.5) / 2.0**32
                for cell, *n in zip(own, *numbers, strict=True):
                    a, b, c, d = map(int, n)
                    at = tuple(cell[k] for k in keys)
                    if at not in hits:
                        hits[at], fixed[at] = np.zeros(reps, np.int64), np.zeros(4, np.int64)
                    hits[at] += hypergeometric_draws(a + b + c + d, a + c, a + b, u)
                    fixed[at] += (a, b, c, d)
        if hits:
            yield pd.DataFrame({**{k: [at[i] for at in hits] for i, k in enumerate(keys)}, **{c: [int(v[i]) for v in fixed.values()] for i, c in enumerate(names)}, "hits": list(hits.values())})

    types = {f.name: f.dataType.simpleString() for f in counts.schema}
    kind = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{c} bigint" for c in names] + ["hits array<bigint>"])
    parts = sharing.select("who", cells.alias("cells"), *(F.col("cells")[c].alias(c) for c in names)).mapInPandas(summed, kind)
    each = parts.select(*keys, "tp", "fp", "fn", "tn", F.posexplode("hits").alias("rep", "hit"))
    moved = F.col("hit") - F.col("tp")
    sums = each.groupBy(*keys, "rep").agg(F.sum("hit").alias("tp"), F.sum(F.col("fp") - moved).alias("fp"), F.sum(F.col("fn") - moved).alias("fn"), F.sum(F.col("tn") + moved).alias("tn"))
    return sums.select(*keys, macro_f1().alias("f")).groupBy(*keys).agg(F.avg("f").alias("floor_mean"), F.expr("percentile(f, 0.95)").alias("floor_p95"))
