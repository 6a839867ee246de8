import numpy as np
import pytest
from pyspark.sql import functions as F

from sigaudit.functions import arrays, dsp, metrics, text
from sigaudit.operators import report


def one(spark, expr, **cols):
    kinds = {list: "array<double>", float: "double", int: "int", str: "string", bool: "boolean"}
    df = spark.createDataFrame([tuple(cols.values())] if cols else [(0,)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in cols.items()) or "x int")
    return df.select(expr.alias("r")).first()["r"]


def test_downsampling(spark):
    x = [float(i) for i in range(1000)]
    got = one(spark, arrays.uniform_stride(F.col("x"), 256), x=x)
    assert len(got) == 256 and (got[0], got[-1]) == (0.0, 999.0) and got == [x[int(i)] for i in np.round(np.linspace(0, 999, 256))]
    assert one(spark, arrays.uniform_stride(F.col("x"), 256), x=x[:10]) == x[:10]
    assert one(spark, arrays.bin_mean(F.col("x"), 4), x=x[:8]) == [0.5, 2.5, 4.5, 6.5]
    with pytest.raises(ValueError):
        arrays.downsample(F.col("x"), "other", 4)


def test_linear_resample_is_interpolation(spark):
    x = [1.0, 4.0, 2.0, 8.0]
    assert np.allclose(one(spark, arrays.linear_resample(F.col("x"), 7), x=x), np.interp(np.linspace(0, 1, 7), np.linspace(0, 1, 4), x))


def test_macro_f1_counts_labels_that_occur(spark):
    rows = spark.createDataFrame([("a", 0, 0, False)] * 3 + [("b", 1, 0, False), ("b", 1, 1, False), ("c", 1, None, True)], "subject string, y int, yhat int, failure boolean")
    got = {r["subject"]: (r["n"], r["macro_f1"]) for r in metrics.macro_f1_rollup(rows).collect()}
    assert got["a"] == (3, 1.0) and got["b"] == (2, pytest.approx(1 / 3)) and "c" not in got and got[None][0] == 5


def test_auroc(spark):
    def area(y, s):
        return metrics.auroc(spark.createDataFrame([("k", a, float(b)) for a, b in zip(y, s)], "k string, y int, s double"), "s", ["k"]).first()["auroc"]

    assert area([0, 0, 1, 1], [0, 0.1, 0.8, 0.9]) == 1 and area([0, 1, 0, 1], [1, 1, 1, 1]) == 0.5 and area([1, 1], [1, 2]) is None


def test_holm(spark):
    def adjusted(ps):
        df = spark.createDataFrame([(i, "f", p) for i, p in enumerate(ps)], "i int, f string, p double")
        return [None if r["p_holm"] is None else round(r["p_holm"], 9) for r in metrics.holm(df, "p", ["f"], ["i"]).orderBy("i").collect()]

    assert adjusted([0.01, 0.04, 0.03]) == [0.03, 0.06, 0.06] and adjusted([0.01, None, 0.04]) == [0.02, None, 0.04]


def test_ratios_and_gate(spark):
    v = lambda e: one(spark, e)
    assert v(metrics.sds(F.lit(0.60), F.lit(0.41), F.lit(0.42))) == pytest.approx(0.19 / 0.18)
    assert v(metrics.gated_sds(F.lit(0.6), F.lit(0.7), F.lit(0.42), F.lit(0.5))) < 0
    assert v(metrics.gated_sds(F.lit(0.6), F.lit(0.7), F.lit(0.42), F.lit(0.42))) is None
    assert v(report.sds_text(F.lit(0.625), F.lit(0.40) > F.lit(0.42))) == report.UNDEFINED


def test_wilcoxon():
    assert report.wilcoxon_p([0.4] * 4) is None and report.wilcoxon_p([0.0] * 9) is None
    assert report.wilcoxon_p([0.4] * 6) < 0.05
    assert report.wilcoxon_p([0.1 * i for i in range(1, 8)] + [0.0] * 6) == pytest.approx(0.015625)
    assert report.wilcoxon_p([0.5] + [0.0] * 19) == pytest.approx(0.3173, abs=1e-4)


def test_numbers_in_text(spark):
    n = lambda t: one(spark, text.first_number(F.col("t")), t=t)
    assert (n("Answer: 3"), n("I think 2, or maybe 5"), n("N/A"), n("")) == (3.0, 2.0, None, None)
    assert one(spark, text.label_of(F.col("t")), t="The level is 2.") == 2
    assert one(spark, text.bracket_list(F.col("t"), "HR"), t="x [HR]: [60, 70.5] y") == [60.0, 70.5]
    with pytest.raises(Exception, match="no label"):
        one(spark, text.label_of(F.col("t")), t="none")


def test_sentences(spark):
    s = lambda f, v, m, **k: one(spark, text.verbalized(f, F.lit(v).cast("double"), F.lit(m), **k))
    assert s("eda_level_mean", 10.0, 5.0) == "eda_level_mean is elevated (10), stress-typical."
    assert s("hrv_sdnn", 1.0, 5.0) == "hrv_sdnn is reduced (1), stress-typical."
    assert s("hrv_sdnn", None, 5.0) == "hrv_sdnn is unavailable."
    assert s("eda_level_mean", 10.0, 5.0, variant="ii", percentile=F.lit(100.0)) == "eda_level_mean is 10 (percentile 100)."


def test_signal_kernels():
    t = np.arange(0, 60, 1 / 50)
    at = dsp.beats(np.sin(2 * np.pi * 1.2 * t) ** 15, 50)
    assert 69 <= len(at) <= 74
    assert all(v is None for v in dsp.hrv_time(np.diff(dsp.beats(np.zeros(4200), 70.0))).values())
    assert dsp.skin(np.zeros(200), 4.0)["eda_scr_amp_mean"] == 0.0
    assert dsp.breath(np.sin(2 * np.pi * 0.25 * t), 50)["resp_rate_mean"] == pytest.approx(15, abs=0.5)
    f, p = dsp.welch(np.sin(2 * np.pi * 0.25 * np.arange(512) / 4), 4.0)
    assert f[p.argmax()] == pytest.approx(0.25, abs=0.02)


def test_sensor_texts(spark):
    from sigaudit.functions import anchor_text as a

    body = "x [Steps]: [100, 300] [Burned Calorories]: [20,20] [Resting Heart Rate]: [60, 70] [SleepMinutes]: [400, 500] [Mood]: 3 out of 5"
    ask = lambda f, t=body: one(spark, f(F.col("t")), t=t)
    assert "Steps: 200.0 steps, Burned Calories: 20.0 calories, Resting Heart Rate: 65.00 beats/min, Sleep Minutes: 450.0 minutes, Mood: 3 out of 5." in ask(a.averaged_question)
    assert "Resting Heart Rate: [60.00, 70.00] beats/min" in ask(a.listed_question) and "[Steps]: [100.0, 300.0] steps" in ask(a.case_question)
    assert one(spark, a.framed(F.lit("Q"), "### ")).startswith("### Instruction: ") and one(spark, a.framed(F.lit("Q"))).endswith("Question: Q\nResponse:")
    with pytest.raises(Exception, match="no Steps list"):
        ask(a.averaged_question, "nothing")
