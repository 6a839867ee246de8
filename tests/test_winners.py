import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigaudit.functions import text
from sigaudit.operators import winners

ROWS = "dataset string, window_id string, y int, body string"


def tables(spark, won):
    rows = spark.createDataFrame([("p", "1", 0, "b one"), ("p", "2", 1, "b two"), ("q", "3", 0, "c three")], ROWS)
    shown = winners.exemplar_lists(spark.createDataFrame([("p", f"shown {t} {i}", t, i) for t in "AB" for i in range(5)] + [("q", "lone", "A", 0)], "dataset string, body string, token string, place int"), ["dataset"], ["place"], 4)
    return rows, spark.createDataFrame(won, "dataset string, template_id string, n_shot int"), shown


def test_two_winners_of_different_templates_in_one_plan(spark):
    got = {r["window_id"]: r for r in winners.prompts_of_winners(*tables(spark, [("p", "clinical", 2), ("q", "minimal", 0)]), ["dataset"]).collect()}
    choice = text.CHOICE.format(a="calm", b="stress")
    assert got["3"]["prompt"] == f"{choice}\nc three\nAnswer:"
    assert got["1"]["prompt"] == f"You are scoring a 60-second wearable window for a binary state.\n{choice}\nExamples:\nshown A 0\nAnswer: A\nshown B 0\nAnswer: B\n\nb one\nAnswer:"


def test_exemplars_are_bounded_and_take_turns(spark):
    shown = {r["dataset"]: [(e["token"], e["body"][-1]) for e in r["shown"]] for r in tables(spark, [("p", "minimal", 0)])[2].collect()}
    assert shown == {"p": [("A", "0"), ("B", "0"), ("A", "1"), ("B", "1")], "q": [("A", "e")]}


@pytest.mark.parametrize(
    "won,message",
    [
        ([("p", "clinical", 0)], "no entry for"), ([("p", "clinical", 0), ("q", "minimal", 0), ("q", "clinical", 0)], "2 entries for"),
        ([("p", "clinical", 0), ("q", "other", 0)], "unknown template other"), ([("p", "clinical", 0), ("q", "minimal", 2)], "too few exemplars"),
    ],
)
def test_tables_that_do_not_fit_raise(spark, won, message):
    with pytest.raises(PySparkException, match=message):
        winners.prompts_of_winners(*tables(spark, won), ["dataset"]).collect()


def test_scorer_reads_the_exemplars(spark):
    scored = winners.evaluate(*tables(spark, [("p", "instruction", 4), ("q", "minimal", 0)]), ["dataset"], winners.overlap_scorer())
    assert {r["window_id"]: (r["failure"], round(r["logprob_a"] - r["logprob_b"], 6)) for r in scored.collect()}["3"] == (False, 0.0)
    score = winners.overlap_scorer()
    a, b = score(["x\nExamples:\nred blue\nAnswer: A\ngreen\nAnswer: B\n\nred blue sky\nAnswer:"])[0]
    assert a > b and score(["x\nred\nAnswer:"])[0] == score(["y\nAnswer:"])[0]
    assert scored.where(F.col("n_shot") == 4).count() == 2


def test_rows_are_not_dealt_by_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = winners.prompts_of_winners(*tables(spark, [("p", "clinical", 2), ("q", "minimal", 0)]), ["dataset"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
