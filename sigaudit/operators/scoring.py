"""Scoring prompts through a pluggable scorer, and summaries of scored rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import argmax_label, confusion, macro_f1, usable

#: A scorer takes prompts and returns, for each, (log probability of A, of B); None where a label is missing.
Scorer = Callable[[list[str]], list[tuple[float | None, float | None]]]


def constant_scorer(a: float = -1.0, b: float = -0.5) -> Scorer:
    return lambda prompts: [(a, b)] * len(prompts)


def score_prompts(rows: DataFrame, scorer: Scorer, column: str = "prompt") -> DataFrame:
    """rows with logprob_a, logprob_b, failure (a label without score) and yhat; prompts go to the scorer in Arrow batches."""

    @F.pandas_udf("logprob_a double, logprob_b double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            yield pd.DataFrame(scorer(prompts.tolist()), columns=["logprob_a", "logprob_b"], dtype=float)

    out = rows.withColumn("s", scored(column)).withColumn("logprob_a", F.nanvl("s.logprob_a", F.lit(None))).withColumn("logprob_b", F.nanvl("s.logprob_b", F.lit(None))).drop("s")
    return out.withColumn("yhat", argmax_label(F.col("logprob_a"), F.col("logprob_b"))).withColumn("failure", F.col("yhat").isNull())


def summarise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per condition macro_f1 over usable rows, n_scored and n_failures."""
    ok = usable(rows).groupBy(*keys).agg(F.count("*").alias("n_scored"), *confusion()).select(*keys, "n_scored", macro_f1().alias("macro_f1"))
    failed = rows.groupBy(*keys).agg(F.count_if("failure").alias("n_failures"))
    return failed.join(ok, keys, "left").select(*keys, F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "n_failures", "macro_f1")


def pick_winner(cells: DataFrame, keys: list[str], templates: list[str]) -> DataFrame:
    """Per key the best cell (template_id, n_shot, macro_f1): highest score, missing last; then fewest shots, then order of templates."""
    order = F.array_position(F.array(*map(F.lit, templates)), F.col("template_id"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("macro_f1", F.lit(-1.0))), "n_shot", order)
    return cells.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def lock_problems(winners: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """What is wrong with a table of winners, a row a problem: duplicates, missing scores, wrong number."""
    dup = winners.groupBy(*keys).count().where("count > 1").select(F.lit("duplicate").alias("problem"), F.concat_ws("|", *keys).alias("detail"))
    gap = winners.where(F.col("macro_f1").isNull()).select(F.lit("no score").alias("problem"), F.concat_ws("|", *keys).alias("detail"))
    n = winners.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("count").alias("problem"), F.col("n").cast("string").alias("detail"))
    return dup.unionByName(gap).unionByName(n)


def text_scores(rows: DataFrame, prediction: str, label: str, keys: list[str]) -> DataFrame:
    """Mean absolute error over answers with a number, and the others as failures."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(prediction).alias("parsed"), F.count_if(F.col(prediction).isNull()).alias("failures"), F.avg(F.abs(F.col(prediction) - F.col(label))).alias("mae"))
