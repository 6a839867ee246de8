import io
import json
import threading
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigaudit.functions import detectors
from sigaudit.operators import frame, ladder, locks, multirate, publish
from sigaudit.schemas import FAMILIES, PLAN, RUNGS, feature_columns
from sigaudit.sources import archive

WINDOWS = "window_id string, subject string, y int, channels map<string,array<double>>"


def heart_signal(fs, seconds=60, gap=0.8, noise=0.0):
    """Narrow spikes every gap seconds or a little more or less, on a slow drift; and their places."""
    t = np.arange(int(fs * seconds)) / fs
    at = np.arange(0.5, seconds - 0.3, gap)
    at = at + 0.02 * np.sin(at)
    x = sum(np.exp(-(((t - a) / 0.012) ** 2)) for a in at) + 0.3 * np.sin(2 * np.pi * 0.2 * t)
    return x + noise * np.random.default_rng(1).standard_normal(len(t)), at


def pulse_signal(fs, seconds=60, gap=0.9):
    t = np.arange(int(fs * seconds)) / fs
    at = np.arange(0.6, seconds - 0.4, gap)
    return sum(np.exp(-(((t - a) / 0.12) ** 2)) + 0.3 * np.exp(-(((t - a - 0.32) / 0.1) ** 2)) for a in at) + 0.5 * np.sin(2 * np.pi * 0.1 * t), at


@pytest.mark.parametrize("noise", [0.0, 0.05])
def test_heart_beats_are_where_they_were_put(noise):
    x, at = heart_signal(700, noise=noise)
    got = detectors.heart_beats(x, 700.0) / 700
    assert len(got) == len(at) and np.abs(got - at).max() < 0.03


@pytest.mark.parametrize("fs", [64.0, 102.5])
def test_pulse_beats_are_where_they_were_put(fs):
    x, at = pulse_signal(fs)
    got = detectors.pulse_beats(x, fs) / fs
    assert len(got) == len(at) and np.abs(got - at).max() < 0.06


def test_rhythm_of_known_beats():
    # five beats, gaps of 800, 900, 800, 900 ms
    got = detectors.rhythm(np.array([0, 800, 1700, 2500, 3400]), 1000.0)
    assert got["hrv_mean_nn"] == 850 and got["hrv_rmssd"] == 100 and got["hrv_pnn50"] == 100 and got["hrv_mean_hr"] == pytest.approx(60000 / 850)
    assert got["hrv_sdnn"] == pytest.approx(np.std([800, 900, 800, 900], ddof=1)) and got["hrv_lf"] is None
    assert set(detectors.rhythm(np.array([0, 800, 1700, 2500]), 1000.0).values()) == {None}


def test_breaths_of_a_known_wave():
    t = np.arange(0, 60, 0.05)
    got = detectors.breaths(2 + 0.02 * t + np.sin(2 * np.pi * 0.25 * t) + 0.2 * np.sin(2 * np.pi * 6 * t), 20.0)
    assert got["resp_rate_mean"] == pytest.approx(15, abs=0.5) and got["resp_rate_std"] < 2 and got["resp_amp_mean"] == pytest.approx(2, abs=0.1)
    assert np.isnan(detectors.breaths(np.ones(1200), 20.0)["resp_rate_mean"])


def test_band_of_a_signal():
    t = np.arange(0, 20, 0.01)
    slow, wanted, fast = (np.sin(2 * np.pi * f * t) for f in (0.1, 2.0, 30.0))
    assert np.abs(detectors.band_passed(5 + slow + wanted + fast, 100.0, 0.5, 8.0) - wanted)[200:-200].max() < 0.15
    assert len(detectors.band_passed(np.ones(2), 100.0, 0.5, 8.0)) == 2


@pytest.fixture(scope="module")
def windows(spark):
    ecg, pulse = heart_signal(700)[0], pulse_signal(64.0)[0]
    t = np.arange(0, 60, 0.25)
    skin = 2 + 0.1 * t + np.where(t % 10 < 2, 0.5, 0.0)
    breath = np.sin(2 * np.pi * 0.25 * np.arange(0, 60, 1 / 700))
    rows = [
        ("whole", "S1", 1, {"ecg": ecg.tolist(), "eda": skin.tolist(), "resp": breath.tolist(), "bvp": pulse.tolist(), "ppg": pulse.tolist()}),
        ("no channel", "S1", 0, {}), ("none", "S2", 0, None), ("empty", "S2", 1, {"ecg": [], "eda": [], "resp": [], "bvp": [], "ppg": []}),
        ("gap", "S2", 1, {"eda": [1.0, None, 2.0], "bvp": [float("nan")] * 9, "ecg": [1.0] * 700}), ("flat", "S2", 1, {"eda": [3.0] * 40, "ecg": [1.0] * 7000, "resp": [0.0] * 7000, "ppg": [0.0] * 900}),
    ]
    return spark.createDataFrame(rows, WINDOWS).withColumn("dataset", F.lit("x"))


@pytest.mark.parametrize("dataset", list(PLAN))
def test_feature_frame(windows, dataset):
    rates = {"eda": F.lit(4.0), "ppg": 64.0}
    got = frame.build_feature_frame(windows, dataset, rates)
    assert got.columns == ["window_id", "subject", "y", "dataset", *feature_columns(dataset)]
    rows = {r["window_id"]: r.asDict() for r in got.collect()}
    whole = rows["whole"]
    assert all(whole[c] is not None for c in feature_columns(dataset))
    assert whole["hrv_mean_nn"] == pytest.approx(800 if dataset == "wesad" else 900, abs=3) and whole["hrv_mean_hr"] == pytest.approx(75 if dataset == "wesad" else 66.7, abs=0.5)
    for name in ("no channel", "none", "empty", "gap"):
        assert all(rows[name][c] is None for c in feature_columns(dataset)), name
    flat = rows["flat"]
    assert all(flat[c] is None for c in FAMILIES["hrv"])
    if "eda" in PLAN[dataset]:
        assert whole["eda_level_mean"] == pytest.approx(np.mean(2 + 0.1 * np.arange(0, 60, 0.25) + np.where(np.arange(0, 60, 0.25) % 10 < 2, 0.5, 0)))
        assert whole["eda_scr_count"] >= 5 and flat["eda_level_mean"] == 3 and flat["eda_scr_count"] == 0 and flat["eda_scr_amp_mean"] == 0 and flat["eda_level_std"] == 0
    if "resp" in PLAN[dataset]:
        assert whole["resp_rate_mean"] == pytest.approx(15, abs=0.1) and flat["resp_rate_mean"] is None


def test_feature_frame_of_odd_tables(spark, windows):
    assert frame.build_feature_frame(windows.limit(0), "maus").count() == 0
    with pytest.raises(ValueError, match="no plan"):
        frame.build_feature_frame(windows, "other")
    with pytest.raises(ValueError, match="ids named as features"):
        frame.build_feature_frame(windows.withColumn("hrv_lf", F.lit(1)), "maus")
    report = {r["feature"]: r for r in frame.missing_report(frame.build_feature_frame(windows, "maus", {"ppg": 64.0}), feature_columns("maus")).collect()}
    assert report["hrv_lf"]["missing"] == pytest.approx(5 / 6) and report[None]["empty"] == 5 and report[None]["n"] == 6


def ladder_windows(spark, n=30):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        slow = 20 if i % 3 else 10
        rows.append((f"w{i:03d}", f"S{i % 3}", i % 2, {"bvp": (rng.standard_normal(80) + i).tolist(), "eda": (rng.standard_normal(slow) + 10 * i).tolist()}))
    return spark.createDataFrame(rows, WINDOWS)


def test_rungs_keep_shapes_and_moments(spark):
    w = ladder_windows(spark)
    own = {r["window_id"]: r for r in w.collect()}
    every = {c: np.concatenate([r["channels"][c] for r in own.values()]) for c in ("bvp", "eda")}
    for rung in RUNGS:
        made = ladder.apply_surrogate(w, rung, 3)
        if rung == "deleted":
            assert made is None
            continue
        rows = made.collect()
        assert made.columns == w.columns and len(rows) == 30
        for r in rows:
            mine = own[r["window_id"]]
            assert (r["subject"], r["y"]) == (mine["subject"], mine["y"]) and {c: len(x) for c, x in r["channels"].items()} == {c: len(x) for c, x in mine["channels"].items()}
            if rung == "flatline":
                assert all(np.allclose(x, every[c].mean()) for c, x in r["channels"].items())
            if rung == "iaaft":
                assert all(np.mean(x) == pytest.approx(np.mean(mine["channels"][c])) and np.std(x) == pytest.approx(np.std(mine["channels"][c])) for c, x in r["channels"].items())
        if rung == "gaussian":
            x = np.concatenate([r["channels"]["bvp"] for r in rows])
            assert abs(x.mean() - every["bvp"].mean()) < 1 and x.std() == pytest.approx(every["bvp"].std(), rel=0.1)
        again = {r["window_id"]: r["channels"] for r in ladder.apply_surrogate(w.repartition(5), rung, 3).collect()}
        assert all(np.allclose(again[r["window_id"]][c], x, atol=1e-9) for r in rows for c, x in r["channels"].items())


@pytest.mark.parametrize("same_class", [False, True])
def test_donors_are_of_other_subjects_with_all_channels_and_their_length(spark, same_class):
    w = ladder_windows(spark)
    own = {r["window_id"]: r for r in w.collect()}
    pairs = {r["window_id"]: r["donor"] for r in ladder.donors(w, 5, same_class, salt=4).collect()}
    assert set(pairs) == set(own) and len(set(pairs.values())) > 10
    for a, b in pairs.items():
        assert own[a]["subject"] != own[b]["subject"] and (not same_class or own[a]["y"] == own[b]["y"])
    for r in ladder.from_donors(w, ladder.donors(w, 5, same_class, salt=4)).collect():
        donor, mine = own[pairs[r["window_id"]]]["channels"], own[r["window_id"]]["channels"]
        for c, x in r["channels"].items():
            n, m = len(mine[c]), len(donor[c])
            assert np.allclose(x, np.interp(np.arange(n) * (m - 1) / (n - 1), np.arange(m), donor[c]))


def test_unfit_surrogates_raise(spark):
    w = ladder_windows(spark)
    for bad in (F.transform_values("channels", lambda k, x: F.slice(x, 1, 9)), F.map_filter("channels", lambda k, x: k == "eda"), F.transform_values("channels", lambda k, x: F.transform(x, lambda v: F.lit(float("nan")))), F.lit(None).cast("map<string,array<double>>")):
        with pytest.raises(PySparkException, match="shape of surrogate differs"):
            ladder.checked(w.withColumn("channels", bad), w).collect()
    with pytest.raises(ValueError, match="no window of another subject"):
        ladder.apply_surrogate(w.where("subject = 'S1'"), "subject_perm_broken", 1)
    with pytest.raises(ValueError, match="in class 1"):
        ladder.apply_surrogate(w.where("subject = 'S1' or y = 0"), "subject_perm_preserved", 1)
    with pytest.raises(ValueError, match="unknown rung"):
        ladder.apply_surrogate(w, "other", 1)
    # a donor without one of the channels
    gone = w.withColumn("channels", F.when(F.col("subject") == "S0", F.map_filter("channels", lambda k, x: k == "eda")).otherwise(F.col("channels")))
    with pytest.raises(PySparkException, match="shape of surrogate differs"):
        ladder.apply_surrogate(gone, "subject_perm_broken", 1).collect()
    assert all(ladder.apply_surrogate(w.limit(0), rung, 1).count() == 0 for rung in RUNGS if rung != "deleted")
    short = spark.createDataFrame([("a", "S", 0, {"eda": [1.0, 2.0]}), ("b", "T", 0, {"eda": []})], WINDOWS)
    assert sorted(ladder.apply_surrogate(short, "iaaft", 1).orderBy("window_id").head()["channels"]["eda"]) == [1.0, 2.0]


def test_surrogates_on_disk_and_their_features(spark, tmp_path):
    w, out, target = ladder_windows(spark), str(tmp_path / "windows"), str(tmp_path / "features")
    rungs = ("flatline", "subject_perm_broken", "deleted")
    counts = ladder.materialise(w, "cogwear", out, 3, rungs)
    assert counts == {"real": 30, "flatline": 30, "subject_perm_broken": 30, "deleted": 0}
    assert json.loads((tmp_path / "windows/dataset=cogwear/rung=deleted/none.json").read_text())["signal"] is None
    assert (tmp_path / "windows/dataset=cogwear/rung=flatline/subject=S1").is_dir()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "windows").rglob("*.parquet")}
    assert ladder.materialise(w, "cogwear", out, 3, rungs) == counts and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "windows").rglob("*.parquet")}
    assert ladder.read(spark, out, "cogwear", "real").withColumn("channels", F.to_json("channels")).select(*w.columns).exceptAll(w.withColumn("channels", F.to_json("channels"))).count() == 0
    notes = {m["rung"]: m for m in ladder.features_of_rungs(spark, out, "cogwear", target, rungs=("real", *rungs))}
    assert notes["real"]["n_windows"] == 30 and notes["real"]["n_subjects"] == 3 and not notes["real"]["is_null"] and notes["flatline"]["is_null"] and notes["deleted"]["sha"] is None
    assert notes["flatline"]["nan_rate"] == pytest.approx(8 / 15)
    made = spark.read.parquet(f"{target}/cogwear/flatline")
    assert set(feature_columns("cogwear")) < set(made.columns) and made.where("eda_level_std > 1e-9").count() == 0
    assert ladder.features_of_rungs(spark, out, "cogwear", target, rungs=("real", *rungs)) == list(notes.values())


# archives


def study(path, prefix="study/"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for subject in ("S2", "S10"):
            for name, x in (("ecg", np.arange(5000.0).reshape(-1, 1)), ("label", np.repeat([0, 1, 2, 7], 25).astype(np.int32)), ("acc", np.arange(30, dtype=np.float32).reshape(10, 3))):
                raw = io.BytesIO()
                np.save(raw, x)
                z.writestr(f"{prefix}{subject}/{name}.npy", raw.getvalue())
            z.writestr(f"{prefix}{subject}/eda.csv", "value,time\n1.5,0\n,1\nx,2\n")
            z.writestr(f"{prefix}{subject}/readme.txt", "no data")
            z.writestr(f"{prefix}{subject}/{subject}.pkl", b"\x80\x04.")


def test_archive_members_are_a_task_each_and_streams(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    study(path)
    df = archive.members(spark, path, prefix="^study/", block=100)
    assert df.rdd.getNumPartitions() == 8
    tasks = df.withColumn("task", F.spark_partition_id()).groupBy("member").agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("n"), F.min("subject").alias("s")).collect()
    assert {r["member"]: (r["tasks"], r["n"], r["s"]) for r in tasks} == {f"{s}/{m}": (1, n, s) for s in ("S2", "S10") for m, n in (("ecg.npy", 5000), ("label.npy", 100), ("acc.npy", 10), ("eda.csv", 3))}
    acc = df.where("subject = 'S2' and channel = 'acc'").orderBy("i").collect()
    assert acc[3]["v"] == [9.0, 10.0, 11.0] and [r["i"] for r in acc] == list(range(10))
    assert [r["v"] for r in df.where("subject = 'S2' and channel = 'eda'").orderBy("i").collect()] == [[1.5, 0.0], [None, 1.0], [None, 2.0]]
    assert [m.name for m in archive.ArchiveReader({"path": path, "members": "ecg"}).partitions()] == ["study/S2/ecg.npy", "study/S10/ecg.npy"]
    assert archive.members(spark, path, members="none").count() == 0
    assert archive.members(spark, "file://" + path, members="acc").count() == 20


def test_members_are_read_in_bounded_blocks(tmp_path):
    path = str(tmp_path / "a.zip")
    study(path)
    reader = archive.ArchiveReader({"path": path, "members": "ecg", "block": "64"})
    batches = list(reader.read(reader.partitions()[0]))
    assert max(b.num_rows for b in batches) == 64 and sum(b.num_rows for b in batches) == 5000


def test_pickles_and_broken_members_are_refused(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    raw = io.BytesIO()
    np.save(raw, np.array([{"a": 1}], dtype=object), allow_pickle=True)
    whole = io.BytesIO()
    np.save(whole, np.arange(100.0))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("S1/x.npy", raw.getvalue())
        z.writestr("S1/y.npy", whole.getvalue()[:-9])
        z.writestr("S1/S1.pkl", b"\x80\x04.")
    for member, text in (("x.npy", "not an array of numbers"), ("y.npy", "ends early"), ("pkl", "neither")):
        with pytest.raises(PySparkException, match=text):
            archive.members(spark, path, members=member).collect()


def test_recording_of_labels_at_another_rate(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    study(path)
    got = archive.recording(archive.members(spark, path, members="ecg|label"), (2,), (1,), rates={"ecg": 50.0, "label": 1.0})
    rows = {r["i"]: (r["t_s"], r["v"], r["label"]) for r in got.where("subject = 'S2'").collect()}
    assert min(rows) == 25 * 50 and max(rows) == 75 * 50 - 1 and rows[1250] == (25.0, 1250.0, 0) and rows[2500] == (50.0, 2500.0, 1)


def test_members_are_copied_without_their_prefix(spark, tmp_path):
    path, target = str(tmp_path / "a.zip"), tmp_path / "out"
    study(path)
    got = {r["member"]: r["bytes"] for r in archive.extract(spark, path, str(target), members=r"\.csv$", prefix="^study/").collect()}
    assert got == {"S2/eda.csv": 24, "S10/eda.csv": 24} and (target / "S2/eda.csv").read_text().startswith("value,time")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("../evil.csv", "1")
    with pytest.raises(PySparkException, match="unfit member name"):
        archive.extract(spark, path, str(target)).collect()


# several rates


def test_cut_and_its_reasons(spark):
    kinds = "recording string, channel string, i bigint, v double"
    rows = [("r", "a", i, float(i)) for i in range(100)] + [("r", "b", i, float(i) if i != 20 else float("inf")) for i in range(26)] + [("r", "c", 0, None)]
    w = spark.createDataFrame([("r", 0.0, 1), ("r", 2.5, 2), ("r", 5.0, 3), ("r", 9.5, 4), ("none", 0.0, 5)], "recording string, t0 double, id int")
    got = {r["id"]: r for r in multirate.cut(spark.createDataFrame(rows, kinds), w, {"a": 10.0, "b": 2.5}, 4.0).collect()}
    assert got[1]["dropped"] is None and got[1]["channels"] == {"a": [float(i) for i in range(40)], "b": [float(i) for i in range(10)]}
    # 2.5 s are sample 6.25 of b: 6; samples 6 to 15
    assert got[2]["channels"]["a"][0] == 25.0 and got[2]["channels"]["b"] == [float(i) for i in range(6, 16)]
    assert got[3]["dropped"] == "not finite" and got[3]["channels"] is None and got[4]["dropped"] == "short" and got[5]["dropped"] == "short"
    d = {r["recording"]: (r["n_windows"], r["n_kept"], r["n_short"], r["n_not_finite"]) for r in multirate.drops(multirate.cut(spark.createDataFrame(rows, kinds), w, {"a": 10.0, "b": 2.5}, 4.0)).collect()}
    assert d == {"r": (4, 2, 1, 1), "none": (1, 0, 1, 0), None: (5, 2, 2, 1)}
    assert multirate.cut(spark.createDataFrame([], kinds), w, {"a": 1.0}, 4.0).where("dropped = 'short'").count() == 5
    with pytest.raises(PySparkException, match="there twice"):
        multirate.cut(spark.createDataFrame(rows + rows[:1], kinds), w, {"a": 10.0, "b": 2.5}, 4.0).collect()


def test_starts_are_rounded_half_to_even(spark):
    s = spark.createDataFrame([("r", "a", i, float(i)) for i in range(20)], "recording string, channel string, i bigint, v double")
    w = spark.createDataFrame([("r", 0.5), ("r", 1.5), ("r", 2.5)], "recording string, t0 double")
    assert [r["channels"]["a"][0] for r in multirate.cut(s, w, {"a": 1.0}, 4.0).orderBy("t0").collect()] == [0.0, 2.0, 2.0]


def test_lookup_by_time(spark):
    w = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0008, "y"), ("b", 1.0, "z"), ("a", 7.9999, "v")], "seg_name string, t0 double, window_id string")
    wanted = spark.createDataFrame([("a", 1.0002, 1), ("a", 1.0007, 2), ("a", 8.0, 3), ("a", 5.0, 4), ("b", 1.00099, 5), ("a", 1.0004, 6)], "seg_name string, t0 double, id int")
    looked = multirate.lookup(wanted, w, ["seg_name"])
    assert {r["id"]: r["found"] and r["found"]["window_id"] for r in looked.collect()} == {1: "x", 2: "y", 3: "v", 4: None, 5: "z", 6: "x"}
    with pytest.raises(PySparkException, match="no window at"):
        multirate.found_or_raise(looked).collect()
    assert multirate.found_or_raise(looked.where("id <> 4")).count() == 5


# locks


def test_only_one_of_two_writers_publishes(spark, tmp_path):
    place, results = str(tmp_path / "table"), []

    def write(i):
        try:
            publish.publish(spark.range(1000).withColumn("writer", F.lit(i)), place)
            results.append(i)
        except publish.AlreadyPublished:
            results.append(None)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [r for r in results if r is not None]
    assert len(won) == 1 and len(results) == 4
    kept = spark.read.parquet(place)
    assert kept.count() == 1000 and kept.where(F.col("writer") != won[0]).count() == 0
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["table"]


def test_a_dead_writer_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("dies"))).cast("int"))
    with pytest.raises(PySparkException, match="dies"):
        publish.publish(bad, str(tmp_path / "table"))
    assert not publish.exists(spark, str(tmp_path / "table"))
    publish.publish(spark.range(5), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 5


def test_resume(spark, tmp_path):
    cells = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "setup string, v int")
    path = str(tmp_path / "cells")
    assert [publish.append_missing(cells.where(c), path, ["setup"]) for c in ("setup = 'a'", "true", "true")] == [1, 1, 0]
    assert sorted(r["setup"] for r in publish.read_parts(spark, path, ["setup"]).collect()) == ["a", "b"]


def test_locks(spark, tmp_path):
    root, df = str(tmp_path / "locks"), spark.createDataFrame([(1, "a", None, [1, 2]), (2, "é", 2.5, None)], "id int, s string, f double, l array<int>")
    note = locks.lock(df, root, "floor", {"dataset": "maus", "seed": 1})
    assert note["n_rows"] == 2 and locks.locked(spark, root, "floor", {"seed": 1, "dataset": "maus"}).count() == 2
    assert note["sha256"] == locks.digest(df.repartition(5).select("l", "f", "s", "id")) != locks.digest(df.limit(1)) and locks.digest(df.union(df)) != note["sha256"]
    locks.assert_same(df, root, "floor", {"dataset": "maus", "seed": 1})
    with pytest.raises(publish.AlreadyPublished):
        locks.lock(df, root, "floor", {"dataset": "maus", "seed": 1})
    with pytest.raises(locks.LockError, match="no floor is locked"):
        locks.locked(spark, root, "floor", {"dataset": "wesad"})
    with pytest.raises(locks.LockError, match="differ"):
        locks.assert_same(df.withColumn("f", F.lit(1.0)), root, "floor", {"dataset": "maus", "seed": 1})
    locks.lock(df.limit(1), root, "floor", {"dataset": "wesad"})
    assert {json.loads(r["key"])["dataset"]: r["n_rows"] for r in locks.registry(spark, root, "floor").collect()} == {"maus": 2, "wesad": 1}
    # a row more in the table
    data = next((tmp_path / "locks/floor").glob("*/data"))
    df.limit(1).write.mode("append").parquet(str(data))
    spark.catalog.refreshByPath(str(data))
    key = json.loads((data.parent / "note/lock.json").read_text())["key"]
    with pytest.raises(locks.LockError, match="not what was locked"):
        locks.locked(spark, root, "floor", key)


def test_rows_are_told_apart(spark):
    kinds = "a string, b string"
    tables = [[("x", None)], [(None, "x")], [("x", "")], [("", "x")], [("x-", None)], [("1:x", "")], [("x", "-")]]
    assert len({locks.digest(spark.createDataFrame(t, kinds)) for t in tables}) == len(tables)


def test_locked_lookups_and_invariants(spark):
    entries = spark.createDataFrame([("m1", "a", 0.5), ("m2", "a", 0.25)], "model string, setup string, f1 double")
    wanted = spark.createDataFrame([("m2", "a"), ("m1", "a"), ("m1", "a")], "model string, setup string")
    assert sorted(r["f1"] for r in locks.lookup(wanted, entries, ["model", "setup"]).collect()) == [0.25, 0.5, 0.5]
    with pytest.raises(PySparkException, match="2 entries for"):
        locks.lookup(wanted, entries.union(entries.limit(1)), ["model", "setup"]).collect()
    with pytest.raises(PySparkException, match="no entry for"):
        locks.lookup(wanted, entries.limit(1), ["model", "setup"]).collect()
    assert locks.require(entries, ["model"], 2, never=F.col("setup") == "c") is entries
    bad = entries.union(spark.createDataFrame([("m1", "c", float("nan"))], entries.schema))
    with pytest.raises(locks.LockError, match="3 entries, not 2; 1 entries without f1; 1 entries that may not be; 2 entries for m1"):
        locks.require(bad, ["model"], 2, never=F.col("setup") == "c")
    items = spark.range(6).withColumnRenamed("id", "item_id")
    split = spark.createDataFrame([(1, "train"), (2, "train"), (5, "dev")], "item_id bigint, part string")
    assert locks.locked_items(items, split)[1] == {"train": 2, "dev": 1}
    with pytest.raises(locks.LockError, match="items of the split"):
        locks.locked_items(items.limit(3), split)
    with pytest.raises(locks.LockError, match="twice"):
        locks.locked_items(items, split.union(split.limit(1)))


def test_log_probabilities_of_steps(spark):
    kind = "id int, steps array<struct<token: string, logprob: double>>"
    rows = [(1, [("A", -1.0), (" a", -0.5), ("B", -2.0)]), (2, [("▁B", -0.1), ("Ġa\n", -3.0)]), (3, [("A", -1.0), ("AB", -0.1)]), (4, []), (5, None), (6, [("A", float("-inf")), ("B", -1.0)]), (7, [("b", -1.0), ("a", -1.0)])]
    got = {r["id"]: (r["logprob_a"], r["logprob_b"], r["failure"], r["yhat"]) for r in locks.scored_steps(spark.createDataFrame(rows, kind), "steps", {"a": "A", "b": "B"}).collect()}
    assert got == {1: (-0.5, -2.0, False, 0), 2: (-3.0, -0.1, False, 1), 3: (-1.0, None, True, None), 4: (None, None, True, None), 5: (None, None, True, None), 6: (None, -1.0, True, None), 7: (-1.0, -1.0, False, 0)}
