import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigaudit.functions import metrics
from sigaudit.operators import folds, models, scoring, surrogates


@pytest.fixture(scope="module")
def batch(spark):
    rng = np.random.default_rng(0)
    rows = [("aabb"[i // 2 % 4 if i < 4 else (i - 4) // 2 % 4] if False else "aabbaabb"[i], f"w{i}", int(i >= 4), rng.normal(size=64).tolist()) for i in range(8)]
    return spark.createDataFrame(rows, "subject string, window_id string, y int, x array<double>")


def test_flat_and_noise_keep_pooled_moments(spark, batch):
    x = np.array([r["x"] for r in batch.collect()])
    m = surrogates.pooled_moments(batch).first()
    assert (m["mean"], m["var"]) == (pytest.approx(x.mean()), pytest.approx(x.var()))
    flat = np.array([r["x"] for r in surrogates.flatline(batch).collect()])
    assert np.allclose(flat, x.mean())
    noise = {r["window_id"]: r["x"] for r in surrogates.gaussian(batch, 3).collect()}
    assert abs(np.var(list(noise.values())) / x.var() - 1) < 0.25
    assert noise == {r["window_id"]: r["x"] for r in surrogates.gaussian(batch.repartition(3), 3).collect()}


def test_iaaft_keeps_the_spectrum(spark, batch):
    new = {r["window_id"]: np.array(r["x"]) for r in surrogates.iaaft(batch, 3).collect()}
    for r in batch.collect():
        old = np.array(r["x"])
        assert np.allclose(np.abs(np.fft.rfft(old))[1:-1], np.abs(np.fft.rfft(new[r["window_id"]]))[1:-1], atol=1e-6) and not np.allclose(old, new[r["window_id"]])


@pytest.mark.parametrize("same", [False, True])
def test_donors_are_other_subjects(spark, batch, same):
    of = {r["window_id"]: (r["subject"], r["y"]) for r in batch.collect()}
    got = surrogates.donors(batch, 1, same).collect()
    assert len(got) == 8
    for r in got:
        assert of[r["window_id"]][0] != of[r["donor"]][0] and (not same or of[r["window_id"]][1] == of[r["donor"]][1])


def test_majority_leaves_the_subject_out(spark):
    rows = [("S0", 1)] * 10 + [("S1", 0)] * 8 + [("S1", 1)] * 2 + [("S2", 0)] * 9 + [("S2", 1)]
    got = {r["test_subject"]: r["majority"] for r in folds.majority(spark.createDataFrame(rows, "subject string, y int")).collect()}
    assert got["S0"] == 0


def test_medians_do_not_see_the_held_out_subject(spark):
    rows = lambda bad: spark.createDataFrame([("a", bad), ("b", 1.0), ("c", 3.0), ("c", None)], "subject string, f double")
    med = lambda bad: {r["test_subject"]: r["median_f"] for r in folds.train_medians(rows(bad), ["f"]).collect()}
    assert med(5.0)["a"] == med(-1e9)["a"] == 2.0


def test_splits(spark):
    pool = spark.createDataFrame([(1, "shared"), (2, "only")], "id int, body string")
    held = spark.createDataFrame([(9, "shared")], "id int, body string")
    assert [r["id"] for r in folds.complement(pool, held, "body").collect()] == [2]
    assert folds.leaks(pool, held, "body").count() == 1
    todo, done = spark.range(5).toDF("no"), spark.createDataFrame([(0,), (1,)], "no bigint")
    got = folds.resume(todo, done, "no").orderBy("no").collect()
    assert [r["no"] for r in got] == [2, 3, 4] and not any(r["gap"] for r in got)
    assert all(r["gap"] for r in folds.resume(todo, done.where("no = 0").union(spark.createDataFrame([(3,)], "no bigint")), "no").collect())


def separable(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        y = i % 2
        rows.append((f"S{i // 30}", f"w{i}", y, float(rng.normal(2 * y - 1, 0.3)), float(rng.normal(1 - 2 * y, 0.3)), None if rng.random() < 0.1 else float(rng.normal())))
    return spark.createDataFrame(rows, "subject string, window_id string, y int, f1 double, f2 double, f3 double")


def score(df):
    return df.agg(*metrics.confusion()).select(metrics.macro_f1().alias("f")).first()["f"]


def test_models_separate(spark):
    rows = separable(spark)
    p = models.loso_logreg(rows, ["f1", "f2", "f3"])
    assert p.count() == 240 and score(p) >= 0.9
    assert score(models.loso_tree(rows, ["f1", "f2", "f3"])) >= 0.8


def test_logreg_is_the_penalised_optimum(spark):
    rows = separable(spark).where("subject in ('S0', 'S1', 'S2')").fillna(0.0)
    got = {r["window_id"]: r["score"] for r in models.loso_logreg(rows, ["f1", "f3"]).collect()}
    d = rows.toPandas()
    t, h = d[d.subject != "S0"], d[d.subject == "S0"]
    x, y = t[["f1", "f3"]].to_numpy(), t.y.to_numpy()
    m, s = x.mean(0), x.std(0)
    z = np.c_[(x - m) / s, np.ones(len(x))]
    w = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag([1, 1, 0]), z.T @ (q - y) + np.r_[w[:2], 0])
    assert np.allclose([got[i] for i in h.window_id], np.c_[(h[["f1", "f3"]].to_numpy() - m) / s, np.ones(len(h))] @ w, atol=1e-4)


def test_scoring(spark):
    rows = spark.createDataFrame([("p",), ("q",)], "prompt string")
    got = scoring.score_prompts(rows, lambda prompts: [(-1.0, -2.0) if p == "p" else (None, -1.0) for p in prompts]).orderBy("prompt").collect()
    assert [(r["yhat"], r["failure"]) for r in got] == [(0, False), (None, True)]
    cells = spark.createDataFrame([("d", "clinical", 4, 0.4), ("d", "instruction", 0, 0.4), ("d", "minimal", 0, 0.1)], "dataset string, template_id string, n_shot int, macro_f1 double")
    assert scoring.pick_winner(cells, ["dataset"], ["minimal", "instruction", "clinical"]).first()["template_id"] == "instruction"
    s = spark.createDataFrame([("c", 0, 0, False), ("c", 1, 1, False), ("c", 0, None, True)], "cell string, y int, yhat int, failure boolean")
    assert tuple(scoring.summarise(s, ["cell"]).first()) == ("c", 2, 1, 1.0)


def test_bootstrap_and_votes(spark):
    stats = spark.createDataFrame([(f"s{i}", 3, 0, 0, 7) for i in range(10)], "subject string, tp int, fp int, fn int, tn int")
    ci = metrics.interval(metrics.bootstrap(stats, ["tp", "fp", "fn", "tn"], 50, 1), metrics.macro_f1()).first()
    assert (ci["ci_lo"], ci["ci_hi"], ci["reps"]) == (1.0, 1.0, 50)
    rows = spark.createDataFrame([("t1", 1.0, 1.0), ("t2", 3.0, 3.0), ("q", 5.0, 0.0)], "subject string, a double, b double")
    for negate, want in ((False, 2), (True, -2)):
        got = {r["subject"]: r["vote"] for r in models.adjective_votes(rows, {"a": "eda_tonic_mean", "b": "hrv_sdnn"}, negate).select("subject", F.col("vote")).collect()}
        assert got["q"] == want


def test_ledger_scores_every_rung_with_all_steps(spark, small):
    from sigaudit.plans import queries
    from sigaudit.sources import adapters

    got = queries.surrogate_ledger(spark, small).toPandas()
    assert dict(zip(got.rung, got.is_null, strict=True)) == queries.RUNGS and len(queries.RUNGS) == 6
    w = adapters.sig_windows(spark, small)
    assert set(got.groupby("rung").subject.nunique()) == {w.select("subject").distinct().count()}
    whole = got[got.subject.isna()].set_index("rung")
    assert set(whole.n_rows) == {w.count()} and got[got.rung == "deleted"].macro_f1.isna().all() and got[got.rung != "deleted"].macro_f1.notna().all()
    moved = surrogates.permuted(w, surrogates.donors(w, queries.SEED, False), ["x"])
    p = models.loso_logreg(queries._sig_features(moved), queries.SIG_FEATURES)
    assert abs(whole.macro_f1["subject_perm_broken"] - score(p)) < 1e-12


def _cells(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(c, f"s{i}", *map(int, rng.integers(0, 6, 4))) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "cell string, subject string, tp bigint, fp bigint, fn bigint, tn bigint").repartition(3)


def test_bootstrap_of_cells_deals_each_draw_once(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PLACE_BLOCK", 7)
    monkeypatch.setattr(metrics, "REP_BLOCK", 4)
    stats, names, reps = _cells(spark, {"a": 30, "b": 30, "c": 1, "d": 8}), ["tp", "fp", "fn", "tn"], 9
    got = {(r["cell"], r["rep"]): [r[c] for c in names] for r in metrics.bootstrap_by(stats, ["cell"], names, reps, 5).collect()}
    frame = stats.toPandas().sort_values(["cell", "subject"])
    for cell, own in frame.groupby("cell"):
        x, n = own[names].to_numpy(), len(own)
        for rep in range(reps):
            at = [int(hashlib.md5(f"5:{rep}:{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)]
            assert got.pop((cell, rep)) == x[at].sum(axis=0).tolist()
    assert not got
    places = metrics._drawn_places(spark.createDataFrame([(30,), (8,)], "n_keys bigint"), reps, 5)
    assert sum(len(r["places"]) // 4 for r in places.collect()) == reps * (30 + 8)  # cells of one size share their draws


def test_floor_sends_sums_of_tasks_and_not_draws(spark):
    counts = _cells(spark, {"a": 40, "b": 40})
    floor = metrics.matched_floor(counts, ["cell"], 20, 5)
    assert "ArrowEvalPython" not in floor._jdf.queryExecution().executedPlan().toString()  # draws of a subject stay in their task
    got = {r["cell"]: r["floor_mean"] for r in floor.collect()}
    for cell, own in counts.toPandas().groupby("cell"):
        sums = np.zeros((20, 4))
        for r in own.itertuples():
            u = np.array([int(hashlib.md5(f"5:{i}:{r.subject}".encode()).hexdigest()[:8], 16) for i in range(20)])
            hit = metrics.hypergeometric_draws(r.tp + r.fp + r.fn + r.tn, r.tp + r.fn, r.tp + r.fp, (u + 0.5) / 2.0**32)
            sums += np.stack([hit, r.fp + r.tp - hit, r.fn + r.tp - hit, r.tn - r.tp + hit], axis=1)
        tp, fp, fn, tn = sums.T
        assert got[cell] == pytest.approx(np.mean(tp / (2 * tp + fp + fn) + tn / (2 * tn + fp + fn)))


def test_regression_meets_a_few_folds_at_a_time_and_stops_when_still(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(f"s{i % 5}", f"w{i:03}", int(rng.random() < 0.4), float(rng.normal()), float(rng.normal()) if i % 7 else None) for i in range(100)], "subject string, window_id string, y int, f1 double, f2 double")
    scores = lambda: {r["window_id"]: r["score"] for r in models.loso_logreg(rows, ["f1", "f2"]).collect()}
    whole, seen, given = scores(), [], models.passed
    monkeypatch.setattr(models, "FOLDS", 2)
    monkeypatch.setattr(models, "passed", lambda *a: seen.append(given(*a)) or seen[-1])
    assert scores() == pytest.approx(whole, abs=1e-9)
    assert set(seen[0]) == {0, 1, 2} and len(seen) < 8


def test_folds_of_equal_splits_share_a_pass():
    one, two = ([np.array([1])], [np.array([3])]), ([np.array([1])], [np.array([4])])
    assert models.Tree.alike([one, two, one]) == [[0, 2], [1]]


def _many_subjects(spark, n=600):
    """Four rows a subject, gaps among them; of one subject 150 rows far from all others'."""
    rng = np.random.default_rng(6)
    rows = [(f"s{i % n:03}", f"w{i:05}", int(rng.random() < 0.4), float(rng.normal()), float(rng.exponential()) if i % 7 else None) for i in range(4 * n)]
    rows += [("far", f"x{i:05}", i % 2, float(5 * rng.normal() + 8 * (i % 2)), float(6 * rng.exponential())) for i in range(150)]
    return spark.createDataFrame(rows, "subject string, window_id string, y int, f1 double, f2 double")


def test_many_folds_meet_their_own_rows_only(spark, monkeypatch):
    works, far, given, found = [], [], models.passed, models.Logistic._near

    def near(self, w):
        far.append((yield from found(self, w)))
        return far[-1]

    monkeypatch.setattr(models, "passed", lambda d, work, reps: works.append(work) or given(d, work, reps))
    monkeypatch.setattr(models.Logistic, "_near", near)
    d = models.design(_many_subjects(spark), ["f1", "f2"], "subject", "window_id", "y")
    fit = lambda: models.together(d, [models.Logistic(d, columns=c).fitting(None) for c in ([1, 0], [0])], None)
    got = fit()
    block = models.Block(np.ones(3, np.int64), np.zeros((3, 1), int), np.ones((3, 2)))
    assert max(sum(1 for _ in work(block)) for work in works) == 2  # of two views, and 601 folds in three blocks each
    assert len(far) == 2 and all(0 in f and len(f) < 200 for f in far)  # the first subject is 'far': its fold meets all rows
    monkeypatch.setattr(models, "MANY", 10_000)
    for view, want in zip(got, fit(), strict=True):
        assert view.shape[:2] == (1, 601) and np.allclose(view, want, atol=1e-9)


def test_series_is_the_sum_up_to_its_bound():
    rng = np.random.default_rng(7)
    u, s, y, d = rng.normal(size=(3000, 4)), rng.normal(size=3000), rng.integers(0, 2, 3000), rng.normal(size=(5, 4)) * 0.02
    series = models.Series(4)
    sums = series.sums(u, s, y)
    grad, hess = series.at(series.split(sums), d)
    for g, h, at, rest in zip(grad, hess, d, series.rest(sums[-1], d), strict=True):
        p = 1 / (1 + np.exp(-s - u @ at))
        assert 0 < np.linalg.norm(g - u.T @ (p - y)) < rest < 1e-3
        assert np.allclose(h, (u * (p * (1 - p))[:, None]).T @ u, atol=1e-3)
