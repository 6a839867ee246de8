import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigaudit.functions.png import line_png, plot
from sigaudit.sources import readers
from sigaudit.streaming.windows import cut_segments, hopping_statistics


def test_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for s in ("S10", "S2"):
            z.writestr(f"X/{s}/{s}.pkl", b"0")
    assert [r["subject"] for r in readers.zip_members(spark, str(tmp_path / "a.zip")).collect()] == ["S2", "S10"]
    np.savez(tmp_path / "w.npz", ecg=np.ones((2, 4), np.float32), y=np.array([0, 1], np.int8), t0=np.array([0.0, 30.0]), seg_name=np.array(["a", "b"]))
    got = readers.npz_windows(spark, str(tmp_path / "w.npz")).orderBy("k").collect()
    assert [(r["t0"], r["y"], r["seg_name"]) for r in got] == [(0.0, 0, "a"), (30.0, 1, "b")] and got[0]["channels"]["ecg"] == [1.0] * 4


def test_trials(spark, tmp_path):
    (tmp_path / "002").mkdir()
    (tmp_path / "002/pixart.csv").write_text("Trial 1:0back,Trial 2:2back,Trial 3:1back\n1,2,3\n4,5,6\n,7,8\n")
    got = readers.trial_csv(spark, str(tmp_path / "*/pixart.csv"), ("2", "3"), ("0",), ("002",))
    rows = {(r["trial"], r["i"]): (r["label"], r["fs"], r["v"]) for r in got.collect()}
    assert rows["Trial 1:0back", 0] == (0, 100.0, 1.0) and rows["Trial 2:2back", 2] == (1, 100.0, 7.0) and len(rows) == 6


def sessions(tmp_path, hz):
    for session in ("baseline", "cognitive_load"):
        d = tmp_path / "0" / session
        d.mkdir(parents=True)
        for channel, rate, start in (("bvp", hz, -0.3125), ("eda", 4.0, 0.0)):
            (d / f"empatica_{channel}.csv").write_text("value,time\n" + "".join(f"1,{start + i / rate}\n" for i in range(int(10 * rate))))


def test_sessions(spark, tmp_path):
    sessions(tmp_path, 64.0)
    got = readers.session_csv(spark, str(tmp_path / "*/*/*.csv"), {"bvp": 64.0, "eda": 4.0})
    assert got.agg(F.min("t_s")).first()[0] == 0.0 and got.select("recording").distinct().count() == 2


def test_bad_clock(spark, tmp_path):
    sessions(tmp_path, 50.0)
    with pytest.raises(ValueError, match="does not match nominal"):
        readers.session_csv(spark, str(tmp_path / "*/*/*.csv"), {"bvp": 64.0, "eda": 4.0})


def test_documents_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cells": [{"setup": "a", "macro_f1": 0.5}, {"setup": "b", "macro_f1": None}]}))
    assert readers.cells(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "i.json").write_text(json.dumps([{"instruction": "i", "question": "q", "output": "o"}]))
    assert readers.items(spark, str(tmp_path / "i.json"), 1).first()["body"] == "q"
    with pytest.raises(ValueError):
        readers.items(spark, str(tmp_path / "i.json"), 2)
    m = spark.createDataFrame([("a", 1, None), ("b", 0, 2.0)], "subject string, y int, hrv_lf double")
    out = str(tmp_path / "m")
    assert readers.write_matrix(m, out, ["hrv_lf"]) == {"n_rows": 2, "n_subjects": 2, "n_empty": 1, "nan_rate": {"hrv_lf": 0.5}}
    with pytest.raises(Exception, match="exists"):
        readers.write_matrix(m, out, ["hrv_lf"])
    with pytest.raises(ValueError, match="missing columns"):
        readers.feature_matrix(spark, out, "maus")
    assert readers.content_hash(m) == readers.content_hash(m.repartition(3)) != readers.content_hash(m.limit(1))
    cells = spark.createDataFrame([("a",), ("b",)], "setup string")
    assert [readers.append_missing(cells.limit(n), str(tmp_path / "cells"), ["setup"]) for n in (1, 2, 2)] == [1, 1, 0]
    assert readers.manifest({"b": 1, "a": 2})["config_sha256"] == readers.manifest({"a": 2, "b": 1})["config_sha256"]


def test_plots_are_stable(spark):
    x = [float(np.sin(i / 5)) for i in range(100)]
    got = spark.createDataFrame([(x,), (x,)], "x array<double>").select(plot("x").alias("p")).collect()
    assert bytes(got[0]["p"]) == bytes(got[1]["p"]) == line_png(x) and line_png([]).startswith(b"\x89PNG")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("r", 0.0, 130.0, 0)], "recording string, start_s double, end_s double, label int").write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("recording string, start_s double, end_s double, label int").parquet(str(tmp_path / "s"))
    q = cut_segments(s, 60, 30).format("memory").queryName("cut").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("cut").count() == 3
    spark.sql("select 'r' recording, timestamp'2024-01-01 00:00:10' ts, 1D v union all select 'r', timestamp'2024-01-01 01:00:00', 2D").write.parquet(str(tmp_path / "e"))
    e = spark.readStream.schema("recording string, ts timestamp, v double").parquet(str(tmp_path / "e"))
    q = hopping_statistics(e, "60 seconds", "30 seconds", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("hop").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("hop").count() == 4
