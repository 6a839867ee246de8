"""Assembly of audit reports from scored cells: real against surrogate conditions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics

UNDEFINED = "undefined (validity gate)"


def aligned(real: DataFrame, surrogate: DataFrame, row: str = "window_id") -> DataFrame:
    """Usable rows of both conditions on the row key: real y, yhat, margin and the surrogate's."""
    r, s = metrics.usable(real), metrics.usable(surrogate)
    return r.select("subject", row, "y", "yhat", metrics.margin().alias("margin")).join(s.select(row, F.col("yhat").alias("yhat_surr"), metrics.margin().alias("margin_surr")), row)


def flips(a: DataFrame, b: DataFrame, row: str = "window_id") -> DataFrame:
    """Rows usable in both, with flipped: whether the predictions differ."""
    return aligned(a, b, row).select("subject", row, (F.col("yhat") != F.col("yhat_surr")).cast("int").alias("flipped"))


def sds_text(value: Column, gate_open: Column) -> Column:
    """The ratio with three decimals, or that the gate leaves it undefined."""
    return F.when(gate_open & value.isNotNull(), F.format_string("%.3f", value)).otherwise(UNDEFINED)


def primary(cells: DataFrame, rungs: DataFrame) -> DataFrame:
    """cells (setup, macro_f1, ci_lo, chance) by rungs (setup, rung, macro_f1_surr; is_null): a missing rung stays, with its status."""
    j = cells.join(rungs, "setup", "left")
    value = metrics.gated_sds(F.col("macro_f1"), F.col("macro_f1_surr"), F.col("chance"), F.col("ci_lo"))
    status = F.when(F.col("macro_f1_surr").isNull(), "missing surrogate cell").when(~F.col("is_null"), "descriptive").when(F.col("ci_lo") > F.col("chance"), "ratio").otherwise(UNDEFINED)
    return j.select("setup", "rung", "macro_f1", "macro_f1_surr", (F.col("macro_f1") - F.col("macro_f1_surr")).alias("delta"), F.when(F.col("is_null"), value).alias("sds"), status.alias("status"))


def heatmap(primary_rows: DataFrame, rungs: list[str]) -> DataFrame:
    """Ratios as a row a setup and a column a rung."""
    return primary_rows.groupBy("setup").pivot("rung", rungs).agg(F.first("sds"))


def determinism(locked: DataFrame, again: DataFrame, limit: float = 0.02) -> DataFrame:
    """setup, the move of its score when scored again, and whether it is beyond the limit."""
    j = locked.select("setup", F.col("macro_f1").alias("locked")).join(again.select("setup", F.col("macro_f1").alias("again")), "setup")
    move = F.abs(F.col("again") - F.col("locked"))
    return j.select("setup", move.alias("move"), (move > limit).alias("flag"))


def wilcoxon_statistic(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Signed-rank sums of paired differences, zeros dropped, ties by midrank: n, w_plus, w_minus, statistic."""
    d = pairs.withColumn("d", F.col(a) - F.col(b)).where(F.col("d") != 0).withColumn("m", F.round(F.abs("d"), 9))
    r = d.withColumn("r", metrics.midrank("m", keys))
    w = r.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"))
    return w.withColumn("statistic", F.least("w_plus", "w_minus"))


#: Pairs up to which the signed-rank test is exact even with ties, and up to which it is without.
FEW, EXACT = 13, 50


def signed_rank_p(pairs: int, used: int, plus: float, ties: float, ranks: list[float] | None) -> float | None:
    """Two-sided p of the signed-rank test from its sums: used pairs differ, ties is the sum of t^3 - t over groups of t equal sizes.
    None below five pairs or without a difference. ranks: of the used pairs, where there are few."""
    if pairs < 5 or not used:
        return None
    plain = ties == 0 and used == pairs
    if pairs <= FEW or (plain and used <= EXACT):
        ways = np.array([1.0])  # by twice the sum of ranks
        for r in range(1, used + 1) if plain else ranks:
            step = round(2 * r)
            ways = np.concatenate([ways, np.zeros(step)]) + np.concatenate([np.zeros(step), ways])
        at, share = round(2 * plus), ways / 2.0**used
        return float(min(1.0, 2 * min(share[: at + 1].sum(), share[at:].sum())))
    middle, spread = used * (used + 1) / 4, math.sqrt(used * (used + 1) * (2 * used + 1) / 24 - ties / 48)
    return math.erfc(abs(plus - middle) / spread / math.sqrt(2)) if spread else None


def wilcoxon(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """(keys, n_pairs, n, w_plus, statistic, p) of the paired signed-rank test. Ranks are windows and sums; only up to FEW are gathered."""
    d = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.round(F.col(a) - F.col(b), 9)).withColumn("n_pairs", F.count("*").over(Window.partitionBy(*keys)))
    used = d.where("d <> 0").withColumn("m", F.abs("d"))
    used = used.withColumn("r", metrics.midrank("m", keys)).withColumn("alike", F.count("*").over(Window.partitionBy(*keys, "m")))
    sums = used.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("alike") * F.col("alike") - 1).cast("double").alias("ties"), F.collect_list(F.when(F.col("n_pairs") <= FEW, F.col("r"))).alias("ranks"))
    every = d.groupBy(*keys).agg(F.first("n_pairs").alias("n_pairs")).join(sums, keys, "left")

    @F.pandas_udf("double")
    def p(n_pairs: pd.Series, n: pd.Series, plus: pd.Series, ties: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(*x) for x in zip(n_pairs, n, plus, ties, ranks, strict=True)], dtype=float)

    filled = every.select(*keys, "n_pairs", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce(F.least("w_plus", "w_minus"), F.lit(0.0)).alias("statistic"), F.coalesce("ties", F.lit(0.0)).alias("ties"), F.coalesce("ranks", F.array().cast("array<double>")).alias("ranks"))
    return filled.withColumn("p", F.nanvl(p("n_pairs", "n", "w_plus", "ties", "ranks"), F.lit(None))).drop("ties", "ranks")


def wilcoxon_p(differences: list[float]) -> float | None:
    """p of a few differences that are at hand."""
    every = np.round(np.asarray(differences, float), 9)
    d = every[every != 0]
    order = np.sort(np.abs(d))
    ranks = (np.searchsorted(order, np.abs(d), "left") + np.searchsorted(order, np.abs(d), "right") + 1) / 2
    alike = np.unique(order, return_counts=True)[1]
    return signed_rank_p(len(every), len(d), float(ranks[d > 0].sum()), float((alike**3 - alike).sum()), ranks.tolist())


def markdown(rows: DataFrame, title: str) -> str:
    """A small result as a markdown table (a card has about a hundred rows)."""
    head = f"## {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([head, *("| " + " | ".join(map(show, r)) + " |" for r in rows.collect())])
