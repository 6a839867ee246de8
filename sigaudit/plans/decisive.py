"""The evaluation over a channel that carries the label, so that the validity gate opens and every rung of the ladder is scored from its
own windows; and the DuckDB SQL of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import evaluation, ladder, report
from ..operators.scratch import save
from ..schemas import RUNGS
from ..sources import adapters as src
from .audit import CELL, N_DEV, REPS, SEED, TEMPLATE, _counts, _gate, _rungs, evaluated, gated, r6
from .oracle import GATED, VALUES, bits
from .signals import _donors

#: Views of the channel's level and spread, with the names that stand for them in texts. High values of both go with purchases.
VIEWS = {"level": {"d_mean": "eda_level_mean"}, "spread": {"d_sd": "eda_tonic_mean"}, "both": {"d_mean": "eda_level_mean", "d_sd": "eda_tonic_mean"}}
FEATURES = ["d_mean", "d_sd"]
LADDER = {evaluation.REAL: "i", **dict.fromkeys(RUNGS, "i")}


def purchase_windows(s, d) -> DataFrame:
    """Per hopping window the channel `buy`: one for a purchase and none for another event, and a thousandth of its value; y as ever."""
    w = src.window_values(s, d)
    x = F.when(F.col("code") == "purchase", 1.0).otherwise(0.0) + F.col("v") / 1000.0
    rows = w.groupBy("recording", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", x.alias("x")))), lambda r: r["x"]).alias("x"), (5 * F.count_if(F.col("code") == "purchase") > F.count("*")).cast("int").alias("y"))
    return rows.select(F.col("recording").alias("subject"), F.concat_ws(":", "recording", "k").alias("window_id"), "y", F.create_map(F.lit("buy"), "x").alias("channels"))


def rung_features(windows: DataFrame) -> DataFrame:
    """subject, window_id, y and the features of every rung beside each other, `deleted` left out; nine decimals, as surrogates that keep a
    statistic keep it up to rounding."""
    wide = None
    for rung in (evaluation.REAL, *RUNGS):
        made = windows if rung == evaluation.REAL else ladder.apply_surrogate(windows, rung, SEED, portable=True)
        if made is None:
            continue
        x = F.element_at("channels", F.lit("buy"))
        one = made.select("window_id", F.round(arrays.mean(x), 9).alias(f"d_mean__{rung}"), F.round(arrays.sd(x), 9).alias(f"d_sd__{rung}"))
        wide = windows.select("subject", "window_id", "y").join(one, "window_id") if wide is None else wide.join(one, "window_id")
    return wide


def _scored(s, d) -> DataFrame:
    windows, _ = save(purchase_windows(s, d))
    wide, _ = save(rung_features(windows))
    columns = [f"{c}__{g}" for g in LADDER if g != evaluation.DELETED for c in FEATURES]
    kept, _ = evaluation.held_out_rows(evaluation.left_out(wide, columns), N_DEV, SEED)
    rows, _ = save(evaluation.scored_cells(kept, VIEWS, LADDER, TEMPLATE, evaluation.phrase_scorer()))
    return rows


def decisive_cells(s, d):
    """Every setup and rung: its score and interval."""
    c = evaluation.cells(_scored(s, d), CELL, REPS, SEED)
    return c.select(*CELL, "n_scored", "n_failures", "n_subjects", r6("macro_f1"), r6("ba"), r6("ci_lo"), r6("ci_hi"))


def decisive_primary(s, d):
    """The card's main table where the gate opens: real against surrogate score, the ratio and its status."""
    rows = _scored(s, d)
    counts = _counts(rows)
    out = report.primary(_gate(rows, counts), _rungs(rows, counts))
    return out.select("setup", "rung", r6("macro_f1"), r6("macro_f1_surr"), r6("delta"), r6("sds"), "status")


def decisive_heatmap(s, d):
    rows = _scored(s, d)
    shown = [g for g in RUNGS if g != "subject_perm_preserved"]
    counts = _counts(rows)
    return report.heatmap(report.primary(_gate(rows, counts), _rungs(rows, counts)), shown).select("setup", *map(r6, shown))


QUERIES = {f.__name__: f for f in (decisive_cells, decisive_primary, decisive_heatmap)}

_BASE = VALUES + """, sig as (select recording as subject, recording || ':' || k as window_id, cast(5 * count(*) filter (code = 'purchase') > count(*) as int) as y, list(case when code = 'purchase' then 1.0::double else 0.0::double end + v / 1000.0::double order by i) as x from vals group by recording, k),
uneq as (select window_id, subject, y, 'buy' as channel, x from sig),
flat as (select unnest(x) as v from sig), pool as (select avg(v) as m, sqrt(var_pop(v)) as sd from flat)"""
_SHARE = "((" + bits("1337", "window_id", "'buy'", "i", "'{0}'") + " + 0.5) / 4294967296.0::double)"
_NOISE = f"noise as (select window_id, avg(v) as m, stddev_pop(v) as sd from (select window_id, pool.m + pool.sd * sqrt(-2.0::double * ln({_SHARE.format('r')})) * cos(2 * pi() * {_SHARE.format('a')}) as v from (select window_id, unnest(range(0, len(x))) as i from sig), pool) group by window_id)"
_OWN = "round(list_avg(x), 9), round(list_stddev_pop(x), 9)"
_LONG = f"""long as (select 'real' as signal, subject, window_id, y, round(list_avg(x), 9) as d_mean, round(list_stddev_pop(x), 9) as d_sd from sig
 union all select 'iaaft', subject, window_id, y, {_OWN} from sig
 union all select 'flatline', subject, window_id, y, round(pool.m, 9), 0.0::double from sig, pool
 union all select 'gaussian', subject, window_id, y, round(noise.m, 9), round(noise.sd, 9) from sig join noise using (window_id)
 union all select 'subject_perm_broken', s.subject, s.window_id, s.y, {_OWN.replace('(x)', '(b.x)')} from sig s join moved_b b using (window_id)
 union all select 'subject_perm_preserved', s.subject, s.window_id, s.y, {_OWN.replace('(x)', '(b.x)')} from sig s join moved_k b using (window_id))"""
_MOVED = "moved_{0} as (with {1} select * from moved)"
_EVALUATED = ", ".join([_BASE, _NOISE, _MOVED.format("b", _donors("")), _MOVED.format("k", _donors("y")), _LONG, evaluated(FEATURES, VIEWS, {"d_mean": "up_d_mean", "d_sd": "up_d_sd"}, "sig")])
_GATE = gated(_EVALUATED)
_STATUS = "case when macro_f1_surr is null then 'missing surrogate cell' when not is_null then 'descriptive' when ci_lo > chance then 'ratio' else 'undefined (validity gate)' end"
SQL = {
    "decisive_cells": f"with {_EVALUATED} select setup, signal, cast(n_scored as bigint) as n_scored, 0::bigint as n_failures, n_subjects, round(macro_f1, 6) as macro_f1, round(ba, 6) as ba, round(ci_lo, 6) as ci_lo, round(ci_hi, 6) as ci_hi from cell join ci using (setup, signal) where signal not like 'real:%'",
    "decisive_primary": f"with {_GATE} select setup, rung, round(macro_f1, 6) as macro_f1, round(macro_f1_surr, 6) as macro_f1_surr, round(macro_f1 - macro_f1_surr, 6) as delta, round(case when is_null then {GATED} end, 6) as sds, {_STATUS} as status from gate join rungs using (setup)",
    "decisive_heatmap": f"with {_GATE}, v as (select setup, rung, case when is_null then {GATED} end as sds from gate join rungs using (setup)) select setup, {', '.join(f'round(max(sds) filter (rung = {chr(39)}{r}{chr(39)}), 6) as {r}' for r in RUNGS if r != 'subject_perm_preserved')} from v group by 1",
}
