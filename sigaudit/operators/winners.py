"""Evaluation over locked winners: a row's template, number of shots and exemplars come from joined tables and not from the program."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import locks, scoring

EXAMPLES = "array<struct<body:string,token:string>>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rendered(template: Column, body: Column, examples: Column, meanings: tuple[str, str] = ("calm", "stress")) -> Column:
    """The prompt of a row's own template; the job fails at the first row whose template is not known."""
    out = F.raise_error(F.concat(F.lit("unknown template "), F.coalesce(template, F.lit("null")))).cast("string")
    for name in text.TEMPLATES:
        out = F.when(template == name, text.prompt(body, name, examples, meanings)).otherwise(out)
    return out


def exemplar_lists(pool: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Per keys `shown`, at most most exemplars of pool (keys, body, token) by order, labels in turn: the first of each label, the second
    of each, and so on. Spark limits the rows a key and label before it shuffles them, so no list is longer than most."""
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "token").orderBy(*order))).where(F.col("_r") <= most)
    lists = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "token", "body"))).alias("l"))
    return lists.select(*keys, F.transform(F.slice("l", 1, most), lambda e: F.struct(e["body"].alias("body"), e["token"].alias("token"))).alias("shown"))


def prompts_of_winners(rows: DataFrame, winners: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, body and more) with template_id, n_shot and prompt, by the one winner (keys, template_id, n_shot) and the exemplars
    (keys, shown) of their keys. Raises, as a job, where a key has no winner or two, a template is unknown, or there are fewer exemplars than
    the winner has shots. The exemplars, a few a key, go to the rows, which are not dealt by key: a key may hold a quarter of them."""
    own = locks.lookup(rows, winners.select(*keys, "template_id", "n_shot"), keys, few=True).join(F.broadcast(shown.select(*keys, "shown")), keys, "left")
    have = F.coalesce(F.size("shown"), F.lit(0))
    few = F.concat(F.lit("too few exemplars for "), F.to_json(F.struct(*keys)))
    taken = F.when(F.col("n_shot") == 0, F.array().cast(EXAMPLES)).when(have < F.col("n_shot"), F.raise_error(few).cast(EXAMPLES)).otherwise(F.slice("shown", F.lit(1), F.col("n_shot")))
    return own.withColumn("prompt", rendered(F.col("template_id"), F.col("body"), taken)).select(*rows.columns, "template_id", "n_shot", "prompt")


def evaluate(rows: DataFrame, winners: DataFrame, shown: DataFrame, keys: list[str], scorer: scoring.Scorer) -> DataFrame:
    """Scored rows of every key's winner."""
    return scoring.score_prompts(prompts_of_winners(rows, winners, shown, keys), scorer)


def overlap_scorer() -> scoring.Scorer:
    """A stand-in for a language model that reads the exemplars of a prompt: the log share of each label's exemplars, weighted by the share of their
    words that the body has, one added to each label. Without exemplars both labels are as likely."""

    def score(prompts: list[str]) -> list[tuple[float, float]]:
        out = []
        for prompt in prompts:
            weight, body = {"A": 1.0, "B": 1.0}, prompt.removesuffix("\nAnswer:")
            if "\nExamples:\n" in body:
                *shown, body = re.split(r"\nAnswer: ([AB])\n", body.split("\nExamples:\n", 1)[1])
                words = set(_WORD.findall(body))
                for example, token in zip(shown[::2], shown[1::2], strict=True):
                    own = set(_WORD.findall(example))
                    weight[token] += len(own & words) / max(len(own), 1)
            total = weight["A"] + weight["B"]
            out.append((math.log(weight["A"] / total), math.log(weight["B"] / total)))
        return out

    return score
