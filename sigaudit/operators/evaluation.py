"""Evaluation cells: every held-out subject's windows as text, by statistics of the other subjects, scored by prompt and summed up."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, text
from . import folds, scoring, surrogates
from .ranks import left_out_medians, left_out_shares
from .scratch import save

REAL, DELETED = "real", "deleted"
#: Signals whose windows are made by joins alone; the others of the ladder are made from samples.
SIGNALS = (REAL, "flatline", "subject_perm_broken", "subject_perm_preserved", DELETED)


def phrase_scorer(high: str = "stress-typical", low: str = "calmer-typical") -> scoring.Scorer:
    """A stand-in for a language model: the log share of each label's phrases in the last part of a prompt, one phrase added to each."""

    def score(prompts: list[str]) -> list[tuple[float, float]]:
        out = []
        for prompt in prompts:
            body = prompt.rsplit("\n\n", 1)[-1]
            a, b = body.count(low) + 1, body.count(high) + 1
            out.append((math.log(a / (a + b)), math.log(b / (a + b))))
        return out

    return score


def with_signals(rows: DataFrame, features: list[str], seed: int, signals: Iterable[str] = SIGNALS) -> DataFrame:
    """rows with the features of the real and the other signals beside each other: real ones as <feature>__real, and so on. A row without a
    donor keeps a gap."""
    wide = rows.select("subject", "window_id", "y", *(F.col(c).alias(f"{c}__{REAL}") for c in features))
    if "flatline" in signals:
        wide = wide.crossJoin(F.broadcast(rows.agg(*(F.avg(c).alias(f"{c}__flatline") for c in features))))
    for signal, same in (("subject_perm_broken", False), ("subject_perm_preserved", True)):
        if signal not in signals:
            continue
        donor = rows.select(F.col("window_id").alias("donor"), *(F.col(c).alias(f"{c}__{signal}") for c in features))
        wide = wide.join(surrogates.donors(rows, seed, same).join(donor, "donor").drop("donor"), "window_id", "left")
    return wide


def left_out(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with median_<column>: of all other subjects' values."""
    med = left_out_medians(rows, columns, "subject").groupBy("key").agg(*(F.max(F.when(F.col("f") == c, F.col("median"))).alias(f"median_{c}") for c in columns))
    found, _ = save(med.withColumnRenamed("key", "subject"))  # a row a subject
    return rows.join(found, "subject", "left")


def left_out_percentiles(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with pct_<column>: the share, in percent, of all other subjects' values that are at most the row's."""
    out = rows
    shares, _ = save(left_out_shares(rows, columns, "subject"))
    for c in columns:
        one = shares.where(F.col("f") == c).select(F.col("key").alias("subject"), F.col("v").alias(c), (100.0 * F.col("share")).alias(f"pct_{c}"))
        out = out.join(one, ["subject", c], "left")
    return out


def body(features: dict[str, str], signal: str = REAL, variant: str = "i") -> Column:
    """A row's text (paradigm B): a sentence a feature, or that the signal is deleted. features: column to name shown."""
    if signal == DELETED:
        return surrogates.deleted_text(F.lit("features"))
    column = lambda c: f"{c}__{signal}"
    return F.concat_ws(" ", *(text.verbalized(n, F.col(column(c)), F.col(f"median_{column(c)}") if variant != "ii" else None, F.col(f"pct_{column(c)}") if variant == "ii" else None, variant) for c, n in features.items()))


def series_body(x: str, channel: str, fs: float, scheme: Column, name: str) -> Column:
    """A window's text (paradigm A): the reduced series."""
    return text.series_text(scheme, F.lit(channel), F.lit(fs), F.lit(name))


def scored_cells(wide: DataFrame, setups: dict[str, dict[str, str]], variants: dict[str, str], template: str, scorer: scoring.Scorer) -> DataFrame:
    """Scored rows (setup, signal, subject, window_id, y, logprob_a, logprob_b, failure, yhat) of every setup (feature columns to names
    shown) and signal in variants (signal to verbalizer variant)."""
    parts = [F.struct(F.lit(s).alias("setup"), F.lit(g).alias("signal"), body(f, g.split(":")[0], v).alias("body")) for s, f in setups.items() for g, v in variants.items()]
    rows = wide.select("subject", "window_id", "y", F.explode(F.array(*parts)).alias("p")).select("subject", "window_id", "y", "p.*")
    return scoring.score_prompts(rows.withColumn("prompt", text.prompt(F.col("body"), template)), scorer).drop("prompt", "body")


def held_out_rows(rows: DataFrame, n_dev: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """rows of subjects that prompts were not developed on, and the roles of all subjects. Few subjects: the roles are broadcast."""
    roles = folds.dev_split(rows, n_dev, seed)
    dev = roles.where("role = 'dev'").select("subject")
    return rows.join(F.broadcast(dev), "subject", "left_anti"), roles


def subject_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts of usable rows by the keys and subject."""
    return metrics.usable(rows).groupBy(*keys, "subject").agg(*metrics.confusion(), F.count("*").alias("n"))


def cells(rows: DataFrame, keys: list[str], reps: int, seed: int, roles: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Per cell (keys) n_scored, n_failures, macro_f1, ba, the bootstrap interval over subjects, and n_leaks: rows of subjects that must
    not be scored. counts: of subject_counts, where they are at hand."""
    if counts is None:
        counts, _ = save(subject_counts(rows, keys))
    sums = counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")), F.sum("n").alias("n_scored"), F.count("*").alias("n_subjects"))
    base = sums.select(*keys, "n_scored", "n_subjects", metrics.macro_f1().alias("macro_f1"), metrics.balanced_accuracy().alias("ba"))
    failed = rows.groupBy(*keys).agg(F.count_if("failure").alias("n_failures"))
    drawn = metrics.bootstrap_by(counts, keys, ["tp", "fp", "fn", "tn"], reps, seed)
    ci = metrics.interval(drawn, metrics.macro_f1(), keys=keys).drop("reps")
    out = failed.join(base, keys, "left").join(ci, keys, "left")
    if roles is not None:
        leaks = rows.join(F.broadcast(roles.where("role = 'dev'").select("subject")), "subject", "left_semi").groupBy(*keys).agg(F.count("*").alias("n_leaks"))
        out = out.join(leaks, keys, "left").withColumn("n_leaks", F.coalesce("n_leaks", F.lit(0)))
    return out


def sweep(rows: DataFrame, features: dict[str, str], n_dev: int, shots: list[int], templates: list[str], seed: int, scorer: scoring.Scorer) -> DataFrame:
    """Scored rows (template_id, n_shot ...) of the whole grid over the development subjects: each is held out in turn, shown exemplars
    of the other ones, and verbalised by statistics of all others. rows: as of left_out, with columns <feature>__real."""
    roles = folds.dev_split(rows, n_dev, seed)
    dev = rows.join(F.broadcast(roles.where("role = 'dev'").select("subject")), "subject", "left_semi")
    medians = [f"median_{c}__{REAL}" for c in features]
    held = dev.select("subject", "window_id", "y", body(features).alias("body"))
    pool = dev.drop(*medians).withColumnRenamed("subject", "other").join(F.broadcast(dev.select("subject", *medians).distinct()), F.col("other") != F.col("subject"))
    shown = pool.select("subject", "window_id", "y", body(features).alias("body"))
    empty = F.array().cast("array<struct<body:string,token:string>>")
    every = None
    for n in shots:
        work = held.withColumn("shown", empty)
        if n:  # a few rows a development subject
            picked = folds.exemplars(shown, n, seed, groups=["subject"]).withColumn("token", F.when(F.col("y") == 1, "B").otherwise("A"))
            lists = picked.groupBy("subject").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "pick", "body", "token"))), lambda e: F.struct(e["body"].alias("body"), e["token"].alias("token"))).alias("shown"))
            work = held.join(F.broadcast(lists), "subject", "left").withColumn("shown", F.coalesce("shown", empty))
        grid = F.explode(F.array(*(F.struct(F.lit(t).alias("template_id"), text.prompt(F.col("body"), t, F.col("shown")).alias("prompt")) for t in templates)))
        one = work.select("subject", "window_id", "y", F.lit(n).alias("n_shot"), grid.alias("g")).select("subject", "window_id", "y", "n_shot", "g.*")
        every = one if every is None else every.unionByName(one)
    return scoring.score_prompts(every, scorer)
