"""Registered queries of the evaluation and its card: cells that are scored from prompts, with their intervals and floors, and DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import evaluation, folds, models, report, scoring
from ..operators.scratch import save
from ..schemas import NULL_RUNGS, RUNGS
from ..sources import adapters as src
from .oracle import DONORS, GATED, MATRIX, MID, bits, counts, f1, floor_sql, q

SEED, REPS, N_DEV = 1337, 1000, 2
TEMPLATE = "instruction"
#: Views of the features: columns to the names that stand for them in texts.
VIEWS = {
    "all": {"f_mean": "eda_level_mean", "f_sd": "hrv_sdnn", "f_median": "eda_tonic_mean", "f_step": "hrv_rmssd", "f_max": "hrv_lf"},
    "eda": {"f_mean": "eda_level_mean", "f_median": "eda_tonic_mean"},
    "hrv": {"f_sd": "hrv_sdnn", "f_step": "hrv_rmssd", "f_max": "hrv_lf"},
}
FEATURES = list(VIEWS["all"])
LADDER = {g: "i" for g in evaluation.SIGNALS}
ABLATION = {"real": "i", "real:ii": "ii", "real:iii": "iii"}
CELL = ["setup", "signal"]


def r6(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _matrix(s, d) -> DataFrame:
    return save(src.feature_matrix(s, d))[0]


def _wide(matrix: DataFrame, variants: dict[str, str]) -> DataFrame:
    """The feature matrix with the features of the variants' signals and the medians of the other subjects."""
    signals = [g for g in evaluation.SIGNALS if g in {v.split(":")[0] for v in variants}]
    wide, _ = save(evaluation.with_signals(matrix, FEATURES, SEED, signals))
    out = evaluation.left_out(wide, [f"{c}__{g}" for g in signals if g != evaluation.DELETED for c in FEATURES])
    return evaluation.left_out_percentiles(out, [f"{c}__{evaluation.REAL}" for c in FEATURES]) if "ii" in variants.values() else out


def _kept(matrix: DataFrame, variants: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the evaluation's subjects, and the roles of all."""
    return evaluation.held_out_rows(_wide(matrix, variants), N_DEV, SEED)


def _cells(kept: DataFrame, variants: dict[str, str]) -> DataFrame:
    return save(evaluation.scored_cells(kept, VIEWS, variants, TEMPLATE, evaluation.phrase_scorer()))[0]


def _scored(s, d, variants: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Scored rows of the evaluation's subjects, and the roles of all."""
    kept, roles = _kept(_matrix(s, d), variants)
    return _cells(kept, variants), roles


def _counts(rows: DataFrame) -> DataFrame:
    """Counts of every cell and subject: what all parts of a card start from."""
    return save(evaluation.subject_counts(rows, CELL))[0]


def _per_subject(rows: DataFrame) -> DataFrame:
    return evaluation.subject_counts(rows, CELL).select(*CELL, "subject", metrics.macro_f1().alias("macro_f1"))


def _real(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("signal") == evaluation.REAL)


def _gate(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per setup the real cell, and chance: the mean of the matched floor."""
    cells = evaluation.cells(_real(rows), CELL, REPS, SEED, counts=_real(counts)).drop("signal")
    floor = metrics.matched_floor(_real(counts), ["setup"], REPS, SEED)
    return save(cells.join(floor, "setup").withColumn("chance", F.col("floor_mean")))[0]  # a row a setup


def _rungs(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per setup and rung of the whole ladder the surrogate cell, if it is there."""
    every = rows.select("setup").distinct().select("setup", F.explode(F.array(*map(F.lit, RUNGS))).alias("rung")).withColumn("is_null", F.col("rung").isin(*NULL_RUNGS))
    found = counts.groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))
    found = found.select("setup", F.col("signal").alias("rung"), metrics.macro_f1().alias("macro_f1_surr"), metrics.balanced_accuracy().alias("ba_surr"))
    return every.join(found, ["setup", "rung"], "left")


def _paired(c: DataFrame) -> DataFrame:
    """Per setup, rung and subject: counts of both conditions and both scores."""
    names = ("tp", "fp", "fn", "tn")
    other = c.where(F.col("signal") != evaluation.REAL).select("setup", F.col("signal").alias("rung"), "subject", *(F.col(n).alias(f"{n}2") for n in names))
    both = _real(c).select("setup", "subject", *names).join(other, ["setup", "subject"])
    return both.withColumn("f", metrics.macro_f1()).withColumn("f2", metrics.macro_f1("tp2", "fp2", "fn2", "tn2"))


def eval_cells(s, d):
    rows, roles = _scored(s, d, LADDER)
    c = evaluation.cells(rows, CELL, REPS, SEED, roles)
    return c.select(*CELL, "n_scored", "n_failures", "n_subjects", r6("macro_f1"), r6("ba"), r6("ci_lo"), r6("ci_hi"), "n_leaks")


def card_primary(s, d):
    rows, _ = _scored(s, d, LADDER)
    counts = _counts(rows)
    base = report.primary(_gate(rows, counts), _rungs(rows, counts))
    pairs, _ = save(_paired(counts))
    tests = report.wilcoxon(pairs, "f", "f2", ["setup", "rung"]).select("setup", "rung", "p")
    drawn = metrics.bootstrap_by(pairs, ["setup", "rung"], ["tp", "fp", "fn", "tn", "tp2", "fp2", "fn2", "tn2"], REPS, SEED)
    ci = metrics.interval(drawn, metrics.macro_f1() - metrics.macro_f1("tp2", "fp2", "fn2", "tn2"), keys=["setup", "rung"]).select("setup", "rung", F.col("ci_lo").alias("delta_lo"), F.col("ci_hi").alias("delta_hi"))
    out = base.join(tests, ["setup", "rung"], "left").join(ci, ["setup", "rung"], "left")
    null = out.withColumn("all", F.lit(1)).withColumn("q", F.when(F.col("rung").isin(*NULL_RUNGS), F.col("p")))
    held = metrics.holm(null, "q", ["all"], ["setup", "rung"])
    return held.select("setup", "rung", *(r6(c) for c in ("macro_f1", "macro_f1_surr", "delta", "delta_lo", "delta_hi", "sds")), "status", r6("p", 4), r6("p_holm", 4))


def card_secondary(s, d):
    rows, _ = _scored(s, d, LADDER)
    counts = _counts(rows)
    scored = metrics.usable(rows).withColumn("m", F.round(metrics.margin(), 9))
    area = metrics.auroc(scored, "m", CELL).select(*CELL, "auroc")
    spread = scored.groupBy(*CELL).agg(F.stddev_pop("m").alias("sd"), F.count("*").alias("n"))
    noise = spread.where(F.col("signal") == evaluation.DELETED).select("setup", F.col("sd").alias("noise"))
    real = _gate(rows, counts).join(_real(area).select("setup", "auroc"), "setup").join(_real(spread).select("setup", "sd", "n"), "setup").join(noise, "setup", "left")
    j = real.join(_rungs(rows, counts), "setup").join(area.select("setup", F.col("signal").alias("rung"), F.col("auroc").alias("auroc_surr")), ["setup", "rung"], "left")
    ratio = lambda a, b: F.when(F.col(a) > 0.5, (F.col(a) - F.col(b)) / (F.col(a) - 0.5))
    out = j.withColumn("sds_ba", ratio("ba", "ba_surr")).withColumn("sds_auc", ratio("auroc", "auroc_surr"))
    varies = (F.col("n") >= 2) & F.col("noise").isNotNull() & (F.col("sd") > 10 * F.greatest(F.col("noise"), F.lit(0.01)))
    return out.select("setup", "rung", *(r6(c) for c in ("ba", "ba_surr", "auroc", "auroc_surr", "sds_ba", "sds_auc", "floor_mean", "floor_p95", "sd")), (F.col("macro_f1") > F.col("floor_p95")).alias("above_floor"), varies.alias("varies"))


def sds_gated(s, d):
    rows, _ = _scored(s, d, LADDER)
    counts = _counts(rows)
    j = _gate(rows, counts).join(_rungs(rows, counts).where("macro_f1_surr is not null"), "setup").withColumn("sds", metrics.gated_sds(F.col("macro_f1"), F.col("macro_f1_surr"), F.col("chance"), F.col("ci_lo")))
    return j.select("setup", "rung", r6("sds"))


def card_heatmap_pivot(s, d):
    rows, _ = _scored(s, d, LADDER)
    shown = ["subject_perm_broken", "flatline", "deleted"]
    counts = _counts(rows)
    return report.heatmap(report.primary(_gate(rows, counts), _rungs(rows, counts)), shown).select("setup", *map(r6, shown))


def classical_delta(s, d):
    """The real cell against the majority class of the training folds, and over chance."""
    matrix = _matrix(s, d)
    rows = _cells(_kept(matrix, {"real": "i"})[0], {"real": "i"})
    m = matrix.select("subject", "window_id", "y")
    guess = folds.majority(m).select(F.col("test_subject").alias("subject"), F.col("majority").alias("yhat"))
    kept, _ = evaluation.held_out_rows(m, N_DEV, SEED)
    majority = kept.join(guess, "subject").agg(*metrics.confusion()).select(metrics.macro_f1().alias("classical"))
    j = _gate(rows, _counts(rows)).crossJoin(F.broadcast(majority))
    return j.withColumn("delta", F.col("macro_f1") - F.col("classical")).withColumn("over_chance", F.col("macro_f1") - F.col("chance")).select("setup", r6("classical"), r6("delta"), r6("over_chance"))


def determinism_flags(s, d):
    """The locked cells against a second scoring of the same prompts."""
    kept, _ = save(_kept(_matrix(s, d), {"real": "i"})[0])
    rows, again = _cells(kept, {"real": "i"}), _cells(kept, {"real": "i"})
    one = lambda r: _rungs_free(r)
    return report.determinism(one(rows), one(again)).select("setup", r6("move"), "flag")


def _rungs_free(rows: DataFrame) -> DataFrame:
    return metrics.usable(rows).groupBy("setup").agg(*metrics.confusion()).select("setup", metrics.macro_f1().alias("macro_f1"))


def _ablation(s, d):
    rows, _ = _scored(s, d, ABLATION)
    return rows


def neutralization(s, d):
    rows = _ablation(s, d)
    ii = rows.where("signal = 'real:ii'").groupBy("setup").agg(*metrics.confusion()).select("setup", metrics.macro_f1().alias("f2"))
    j = _gate(rows, _counts(rows)).join(ii, "setup").withColumn("margin_i", F.col("macro_f1") - F.col("chance")).withColumn("margin_ii", F.col("f2") - F.col("chance"))
    j = j.withColumn("loss", F.when((F.col("ci_lo") > F.col("chance")) & (F.col("margin_i") != 0), (F.col("margin_i") - F.col("margin_ii")) / F.col("margin_i")))
    return j.select("setup", r6("margin_i"), r6("margin_ii"), r6("loss"), F.coalesce(F.col("loss") > 0.5, F.lit(False)).alias("p2"))


def ablation_panel(s, d):
    """Per setup: macro F1 of the verbalizer's variants, flips of variant iii with their interval and verdict, and paired tests."""
    rows = _ablation(s, d)
    score = metrics.usable(rows).groupBy(*CELL).agg(*metrics.confusion()).select(*CELL, metrics.macro_f1().alias("f"))
    wide = score.groupBy("setup").agg(*(F.max(F.when(F.col("signal") == g, F.col("f"))).alias(f"macro_f1_{n}") for g, n in zip(ABLATION, ("i", "ii", "iii"), strict=True)))
    pick = lambda g: metrics.usable(rows.where(F.col("signal") == g)).select("setup", "subject", "window_id", F.col("yhat").alias(f"p{g[5:]}"))
    flips = pick("real").join(pick("real:iii"), ["setup", "subject", "window_id"]).groupBy("setup", "subject").agg(F.sum((F.col("p") != F.col("piii")).cast("int")).alias("flips"), F.count("*").alias("n"))
    rate = flips.groupBy("setup").agg((F.sum("flips") / F.sum("n")).alias("flip_rate"))
    ci = metrics.interval(metrics.bootstrap_by(flips, ["setup"], ["flips", "n"], REPS, SEED), F.col("flips") / F.col("n"), keys=["setup"]).select("setup", F.col("ci_lo").alias("flip_lo"), F.col("ci_hi").alias("flip_hi"))
    tests = report.wilcoxon(_paired(_counts(rows)), "f", "f2", ["setup", "rung"]).groupBy("setup").agg(*(F.max(F.when(F.col("rung") == f"real:{n}", F.col("p"))).alias(f"p_{n}") for n in ("ii", "iii")))
    out = wide.join(rate, "setup").join(ci, "setup").join(tests, "setup", "left")
    return out.select("setup", *(r6(c) for c in ("macro_f1_i", "macro_f1_ii", "macro_f1_iii", "flip_rate", "flip_lo", "flip_hi")), (F.col("flip_rate") > 0.4).alias("p3"), r6("p_ii", 4), r6("p_iii", 4))


SHOTS = [0, 4]


def _grid(s, d):
    matrix = _matrix(s, d).select("subject", "window_id", "y", *(F.col(c).alias(f"{c}__{evaluation.REAL}") for c in FEATURES))
    given, _ = save(evaluation.left_out(matrix, [f"{c}__{evaluation.REAL}" for c in FEATURES]))
    every = None
    for view, features in VIEWS.items():
        rows = evaluation.sweep(given, features, N_DEV, SHOTS, list(text.TEMPLATES), SEED, evaluation.phrase_scorer()).withColumn("dataset", F.lit(view))
        every = rows if every is None else every.unionByName(rows)
    scored, _ = save(every)
    return scoring.summarise(scored, ["dataset", "template_id", "n_shot"])


def sweep_grid(s, d):
    return _grid(s, d).select("dataset", "template_id", "n_shot", "n_scored", "n_failures", r6("macro_f1"))


def pick_winner(s, d):
    return scoring.pick_winner(_grid(s, d), ["dataset"], list(text.TEMPLATES)).select("dataset", "template_id", "n_shot", r6("macro_f1"))


def lock_invariants(s, d):
    """What is wrong with the whole grid taken for a lock: one winner a dataset is expected."""
    return scoring.lock_problems(_grid(s, d), ["dataset"], len(VIEWS))


def vote_vs_model(s, d):
    """Agreement and rank correlation, a subject, of adjective votes and of the real cell's margins. Votes and texts go by the same
    medians, which are looked up once; what is ranked is a saved table of three numbers a window."""
    kept, _ = save(_kept(_matrix(s, d), {"real": "i"})[0])
    real = {f"{c}__{evaluation.REAL}": name for c, name in VIEWS["all"].items()}
    votes = models.voted(kept, real).select("window_id", "vote", F.col("yhat").alias("voted"))
    rows = evaluation.scored_cells(kept, {"all": VIEWS["all"]}, {"real": "i"}, TEMPLATE, evaluation.phrase_scorer())
    both, _ = save(metrics.usable(rows).select("subject", "window_id", "yhat", F.round(metrics.margin(), 9).alias("m")).join(votes, "window_id"))
    agree = both.groupBy("subject").agg(F.count("*").alias("n"), F.round(F.avg((F.col("yhat") == F.col("voted")).cast("double")), 6).alias("agreement"))
    return agree.join(metrics.spearman(both, "vote", "m", ["subject"]).select("subject", r6("spearman")), "subject")


def ceilings(s, d):
    """What the features of each view can give: the regression's macro F1 over all subjects and over those of the evaluation."""
    m = _matrix(s, d)
    roles = folds.dev_split(m, N_DEV, SEED)
    scored = models.loso_logregs(m, {view: list(features) for view, features in VIEWS.items()})
    counts, _ = save(scored.join(F.broadcast(roles), "subject").groupBy("view", "role").agg(F.count("*").alias("n"), *metrics.confusion()))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "tp", "fp", "fn", "tn")]
    out = None
    for view in VIEWS:
        p = counts.where(F.col("view") == view)
        of = lambda rows, part: rows.agg(*sums).select(F.lit(view).alias("view"), F.lit(part).alias("part"), "n", metrics.macro_f1().alias("macro_f1"))  # noqa: B023, E731
        one = of(p, "all").unionByName(of(p.where("role = 'eval'"), "eval"))
        out = one if out is None else out.unionByName(one)
    return out.select("view", "part", "n", r6("macro_f1"))


QUERIES = {f.__name__: f for f in (eval_cells, card_primary, card_secondary, sds_gated, card_heatmap_pivot, classical_delta, determinism_flags, neutralization, ablation_panel, sweep_grid, pick_winner, lock_invariants, vote_vs_model, ceilings)}


# the same in SQL


def _donors(suffix: str, **parts: str) -> str:
    named = re.sub(r"\b(blk|blocks|placed|drawn|pairs)\b", rf"\1_{suffix}", DONORS.format(**parts))
    return named.replace("from sig", "from fm")


_COLUMNS = "f_mean f_sd f_median f_step f_max".split()
_PHRASES = {"f_mean": "up_f_mean", "f_median": "up_f_median", "f_sd": "1 - up_f_sd", "f_step": "1 - up_f_step"}


def _phrases(features, phrases: dict[str, str]) -> str:
    some = [phrases[c] for c in features if c in phrases]
    return " + ".join(f"coalesce({x}, 0)" for x in some) + " as p, " + " + ".join(f"coalesce(1 - ({x}), 0)" for x in some) + " as q"


def evaluated(columns: list[str], views: dict, phrases: dict[str, str], base: str) -> str:
    """From the features of all signals (long) to cells with their intervals; base: the table of all subjects."""
    return f"""lmed as (select a.signal, a.subject, {', '.join(f'quantile_cont(b.{c}, 0.5) as m_{c}' for c in columns)} from (select distinct signal, subject from long) a join long b on a.signal = b.signal and a.subject <> b.subject group by 1, 2),
ups as (select l.signal, l.subject, l.window_id, l.y, {', '.join(f'case when {c} is not null then cast(coalesce({c} > m_{c}, false) as int) end as up_{c}' for c in columns)} from long l left join lmed using (signal, subject)),
spoken as ({' union all '.join(f"select '{v}' as setup, signal, subject, window_id, y, {_phrases(views[v], phrases)} from ups" for v in views)}),
full_ as (select * from spoken union all select setup, 'deleted', subject, window_id, y, 0, 0 from spoken where signal = 'real' union all select setup, 'real:ii', subject, window_id, y, 0, 0 from spoken where signal = 'real' union all select setup, 'real:iii', subject, window_id, y, q, p from spoken where signal = 'real'),
ranked as (select subject, row_number() over (order by {bits('1337', 'subject')}, subject) as place from (select distinct subject from {base})),
dev as (select subject from ranked where place <= 2),
every as (select *, cast(p > q as int) as yhat, round(ln((p + 1) / (p + q + 2.0::double)) - ln((q + 1) / (p + q + 2.0::double)), 9) as m from full_),
scored as (select * from every where subject not in (select subject from dev)),
st as (select setup, signal, subject, count(*) as n, {counts()} from scored group by 1, 2, 3),
sub as (select setup, signal, subject, n, tp, fp, fn, tn, {f1()} as f from st),
cell as (select setup, signal, n_scored, n_subjects, tp, fp, fn, tn, {f1()} as macro_f1, (tp / nullif(cast(tp + fn as double), 0) + tn / nullif(cast(tn + fp as double), 0)) / 2 as ba from (select setup, signal, sum(n) as n_scored, count(*) as n_subjects, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from st group by 1, 2)),
idx as (select *, row_number() over (partition by setup, signal order by subject) - 1 as idx, count(*) over (partition by setup, signal) as n_keys from st),
draws as (select setup, signal, rep, {bits('1337', 'rep', 'k')} % n_keys as idx from (select setup, signal, idx as k, n_keys from idx) cross join (select unnest(generate_series(0, {REPS - 1})) as rep)),
ci as (select setup, signal, quantile_cont(v, 0.025) as ci_lo, quantile_cont(v, 0.975) as ci_hi from (select setup, signal, {f1()} as v from (select setup, signal, rep, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from draws join idx using (setup, signal, idx) group by 1, 2, 3)) group by 1, 2)"""


EVAL = MATRIX + ", " + _donors("b", c="", p="", j="") + ", " + _donors("k", c="y,", p="partition by y", j="and w.y = p.y") + f""",
long as (select 'real' as signal, subject, window_id, y, {', '.join(_COLUMNS)} from fm
 union all select 'flatline', subject, window_id, y, {', '.join(f'(select avg({c}) from fm)' for c in _COLUMNS)} from fm
 union all select 'subject_perm_broken', f.subject, f.window_id, f.y, {', '.join('g.' + c for c in _COLUMNS)} from fm f left join pairs_b p on f.window_id = p.window_id left join fm g on g.window_id = p.donor
 union all select 'subject_perm_preserved', f.subject, f.window_id, f.y, {', '.join('g.' + c for c in _COLUMNS)} from fm f left join pairs_k p on f.window_id = p.window_id left join fm g on g.window_id = p.donor),
""" + evaluated(_COLUMNS, VIEWS, _PHRASES, "fm")


def gated(evaluated_: str) -> str:
    """Cells and their gates and rungs."""
    return evaluated_ + ", real_ as (select * from st where signal = 'real'), " + floor_sql("real_", "setup") + """,
gate as (select c.setup, c.macro_f1, c.ba, ci.ci_lo, fl.floor_mean as chance, fl.floor_mean, fl.floor_p95 from cell c join ci using (setup, signal) join fl using (setup) where signal = 'real'),
names as (select unnest(['gaussian', 'iaaft', 'subject_perm_broken', 'flatline', 'deleted', 'subject_perm_preserved']) as rung),
rungs as (select s.setup, names.rung, names.rung <> 'subject_perm_preserved' as is_null, c.macro_f1 as macro_f1_surr, c.ba as ba_surr from (select distinct setup from cell) s cross join names left join cell c on c.setup = s.setup and c.signal = names.rung)"""


GATE = gated(EVAL)
#: erfc by a rational approximation, good to 1.5e-7 (fixed values).
_T = "(1 / (1 + 0.3275911 * x))"
ERFC = f"({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-x * x))"
#: Paired tests of the real condition against every other signal: by sign patterns up to 13 pairs, else normal.
TESTS = f"""pd as (select a.setup, b.signal as rung, a.subject, round(a.f - b.f, 9) as d from sub a join sub b on a.setup = b.setup and a.subject = b.subject where a.signal = 'real' and b.signal <> 'real'),
np as (select setup, rung, count(*) as n_pairs from pd group by 1, 2),
rk as (select setup, rung, d, {MID.format(k='setup, rung', v='abs(d)')} as r, count(*) over (partition by setup, rung, abs(d)) as t, row_number() over (partition by setup, rung order by subject) - 1 as i from pd where d <> 0),
sm as (select setup, rung, count(*) as n, sum(case when d > 0 then r else 0 end) as plus, sum(t * t - 1) as ties from rk group by 1, 2),
pat as (select rk.setup, rk.rung, mask, sum(case when (mask >> i) & 1 = 1 then r else 0 end) as s from rk join sm using (setup, rung) join np using (setup, rung), (select unnest(generate_series(0, 8191)) as mask) where n_pairs <= 13 and mask < (1 << n) group by 1, 2, 3),
few as (select setup, rung, least(1.0, 2 * least(avg(cast(s <= plus + 1e-9 as int)), avg(cast(s >= plus - 1e-9 as int)))) as p from pat join sm using (setup, rung) group by setup, rung),
zs as (select *, abs(plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) / sqrt(2.0) as x from sm),
tests as (select np.setup, np.rung, case when n_pairs < 5 or n is null then null when n_pairs <= 13 then few.p else {ERFC} end as p from np left join zs using (setup, rung) left join few using (setup, rung))"""
PAIRED_CI = f"""two as (select a.setup, b.signal as rung, a.subject, a.tp, a.fp, a.fn, a.tn, b.tp as tp2, b.fp as fp2, b.fn as fn2, b.tn as tn2 from st a join st b on a.setup = b.setup and a.subject = b.subject where a.signal = 'real' and b.signal <> 'real'),
idx2 as (select *, row_number() over (partition by setup, rung order by subject) - 1 as idx, count(*) over (partition by setup, rung) as n_keys from two),
draws2 as (select setup, rung, rep, {bits('1337', 'rep', 'k')} % n_keys as idx from (select setup, rung, idx as k, n_keys from idx2) cross join (select unnest(generate_series(0, {REPS - 1})) as rep)),
ci2 as (select setup, rung, quantile_cont(v, 0.025) as delta_lo, quantile_cont(v, 0.975) as delta_hi from (select setup, rung, {f1()} - {f1('2')} as v from (select setup, rung, rep, {', '.join(f'sum({n}) as {n}' for n in 'tp fp fn tn tp2 fp2 fn2 tn2'.split())} from draws2 join idx2 using (setup, rung, idx) group by 1, 2, 3)) group by 1, 2)"""
STATUS = "case when macro_f1_surr is null then 'missing surrogate cell' when not is_null then 'descriptive' when ci_lo > chance then 'ratio' else 'undefined (validity gate)' end"
_ONLY = "not like 'real%'"


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())


SQL = {
    "eval_cells": q(EVAL, f"select setup, signal, cast(n_scored as bigint) as n_scored, 0::bigint as n_failures, n_subjects, {_r('macro_f1 ba ci_lo ci_hi')}, 0::bigint as n_leaks from cell join ci using (setup, signal) where signal not like 'real:%'"),
    "card_primary": q(GATE + ", " + TESTS + ", " + PAIRED_CI, f""", base as (select *, macro_f1 - macro_f1_surr as delta, case when is_null then {GATED} end as sds, {STATUS} as status from gate join rungs using (setup) left join tests using (setup, rung) left join ci2 using (setup, rung)),
fam as (select setup, rung, p, row_number() over (order by p, setup, rung) as i, count(*) over () as m from base where is_null and p is not null), held as (select setup, rung, least(1.0, max((m - i + 1) * p) over (order by i)) as p_holm from fam)
select setup, rung, {_r('macro_f1 macro_f1_surr delta delta_lo delta_hi sds')}, status, {_r('p p_holm', 4)} from base left join held using (setup, rung)"""),
    "card_secondary": q(GATE, f""", ar as (select setup, signal, y, {MID.format(k='setup, signal', v='m')} as r from scored), ag as (select setup, signal, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg, sum(r) filter (y = 1) as s from ar group by 1, 2), au as (select setup, signal, (s - pos * (pos + 1) / 2.0::double) / nullif(cast(pos * neg as double), 0) as auroc from ag),
sp as (select setup, signal, stddev_pop(m) as sd, count(*) as n from scored group by 1, 2),
j as (select g.setup, r.rung, g.ba, r.ba_surr, a.auroc, b.auroc as auroc_surr, g.floor_mean, g.floor_p95, g.macro_f1, s.sd, s.n, z.sd as noise from gate g join rungs r using (setup) join au a on a.setup = g.setup and a.signal = 'real' left join au b on b.setup = g.setup and b.signal = r.rung join sp s on s.setup = g.setup and s.signal = 'real' left join sp z on z.setup = g.setup and z.signal = 'deleted')
select setup, rung, {_r('ba ba_surr auroc auroc_surr')}, round(case when ba > 0.5 then (ba - ba_surr) / (ba - 0.5) end, 6) as sds_ba, round(case when auroc > 0.5 then (auroc - auroc_surr) / (auroc - 0.5) end, 6) as sds_auc, {_r('floor_mean floor_p95 sd')}, macro_f1 > floor_p95 as above_floor, n >= 2 and noise is not null and sd > 10 * greatest(noise, 0.01) as varies from j"""),
    "sds_gated": q(GATE, f"select setup, rung, round({GATED}, 6) as sds from gate join rungs using (setup) where macro_f1_surr is not null"),
    "card_heatmap_pivot": q(GATE, f", v as (select setup, rung, case when is_null then {GATED} end as sds from gate join rungs using (setup)) select setup, {', '.join(f'round(max(sds) filter (rung = {chr(39)}{r}{chr(39)}), 6) as {r}' for r in ('subject_perm_broken', 'flatline', 'deleted'))} from v group by 1"),
    "classical_delta": q(GATE, f", c0 as (select a.subject, b.y, count(*) as n from (select distinct subject from fm) a join fm b on a.subject <> b.subject group by 1, 2), guess as (select subject, y as yhat from (select *, row_number() over (partition by subject order by n desc, y) as r from c0) where r = 1), mj as (select {counts()} from fm join guess using (subject) where subject not in (select subject from dev)), mf as (select {f1()} as classical from mj) select setup, round(classical, 6) as classical, round(macro_f1 - classical, 6) as delta, round(macro_f1 - chance, 6) as over_chance from gate, mf"),
    "determinism_flags": q(EVAL, "select distinct setup, 0.0::double as move, false as flag from cell"),
    "neutralization": q(GATE, ", v as (select g.setup, macro_f1 - chance as i, f.f2 - chance as ii, ci_lo, chance, macro_f1 from gate g join (select setup, macro_f1 as f2 from cell where signal = 'real:ii') f using (setup)), w as (select *, case when ci_lo > chance and i <> 0 then (i - ii) / i end as loss from v) select setup, round(i, 6) as margin_i, round(ii, 6) as margin_ii, round(loss, 6) as loss, coalesce(loss > 0.5, false) as p2 from w"),
    "ablation_panel": q(EVAL + ", " + TESTS, f""", fl0 as (select a.setup, a.subject, sum(cast(a.yhat <> b.yhat as int)) as flips, count(*) as n from scored a join scored b on a.setup = b.setup and a.window_id = b.window_id where a.signal = 'real' and b.signal = 'real:iii' group by 1, 2),
rate as (select setup, sum(flips) / cast(sum(n) as double) as flip_rate from fl0 group by 1), fi as (select *, row_number() over (partition by setup order by subject) - 1 as idx, count(*) over (partition by setup) as n_keys from fl0),
fd as (select setup, rep, {bits('1337', 'rep', 'k')} % n_keys as idx from (select setup, idx as k, n_keys from fi) cross join (select unnest(generate_series(0, {REPS - 1})) as rep)), fc as (select setup, quantile_cont(v, 0.025) as flip_lo, quantile_cont(v, 0.975) as flip_hi from (select setup, rep, sum(flips) / cast(sum(n) as double) as v from fd join fi using (setup, idx) group by 1, 2) group by 1),
ft as (select setup, {', '.join(f"max(macro_f1) filter (signal = '{g}') as macro_f1_{n}" for g, n in zip(ABLATION, ('i', 'ii', 'iii'), strict=True))} from cell group by 1), fp as (select setup, max(p) filter (rung = 'real:ii') as p_ii, max(p) filter (rung = 'real:iii') as p_iii from tests group by 1)
select setup, {_r('macro_f1_i macro_f1_ii macro_f1_iii flip_rate flip_lo flip_hi')}, flip_rate > 0.4 as p3, {_r('p_ii p_iii', 4)} from ft join rate using (setup) join fc using (setup) left join fp using (setup)"""),
    "sweep_grid": q(EVAL, f", dc as (select setup as dataset, count(*) as n_scored, {counts()} from every where signal = 'real' and subject in (select subject from dev) group by 1) select dataset, template_id, cast(n_shot as int) as n_shot, n_scored, 0::bigint as n_failures, round({f1()}, 6) as macro_f1 from dc, (select unnest(['instruction', 'clinical', 'minimal']) as template_id), (select unnest([0, 4]) as n_shot)"),
    "pick_winner": q(EVAL, f", dc as (select setup as dataset, {counts()} from every where signal = 'real' and subject in (select subject from dev) group by 1) select dataset, 'instruction' as template_id, 0::int as n_shot, round({f1()}, 6) as macro_f1 from dc"),
    "lock_invariants": q(EVAL, ", g as (select distinct setup as dataset from every) select 'duplicate' as problem, dataset as detail from g union all select 'count', cast(6 * count(*) as varchar) from g"),
    "vote_vs_model": q(EVAL, f", vt as (select s.subject, s.m, s.yhat, coalesce(up_f_mean * 2 - 1, 0) + coalesce(1 - up_f_sd * 2, 0) + coalesce(up_f_median * 2 - 1, 0) + coalesce(1 - up_f_step * 2, 0) as vote from scored s join ups using (signal, window_id) where s.signal = 'real' and s.setup = 'all'), r as (select *, {MID.format(k='subject', v='vote')} as ra, {MID.format(k='subject', v='m')} as rb from vt) select subject, count(*) as n, round(avg(cast((vote > 0) = (yhat = 1) as int)), 6) as agreement, round(corr(ra, rb), 6) as spearman from r group by 1"),
}
