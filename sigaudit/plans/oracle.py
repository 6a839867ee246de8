"""DuckDB SQL of the registered audit queries."""

from __future__ import annotations

SAMPLES = "samples as (select cast(user_id as varchar) as recording, row_number() over (partition by user_id order by ts, event_id) - 1 as i, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t_s, value as v, event_type as code from events)"
RUNS = SAMPLES + """, marked as (select *, case when lag(code) over (partition by recording order by i) = code then 0 else 1 end as changed from samples),
numbered as (select *, cast(sum(changed) over (partition by recording order by i) as bigint) as seg_id from marked),
runs as (select * from (select recording, seg_id, cast(min(i) as double) as start_s, cast(max(i) + 1 as double) as end_s, case when code in ('purchase', 'signup') then 1 when code in ('view', 'click') then 0 end as label, code as seg_name from numbered group by recording, seg_id, code) where label is not null)"""
WINDOWS = SAMPLES + """, segs as (select recording, 0.0::double as start_s, max(t_s) as end_s, cast(5 * count(*) filter (code = 'purchase') > count(*) as int) as label from samples group by recording),
wins as (select *, start_s + k * 216000.0::double as t0 from (select *, cast(unnest(generate_series(0, cast(floor((end_s - start_s - 432000 + 1e-9) / 216000) as bigint))) as int) as k from segs where end_s - start_s + 1e-9 >= 432000))"""
VALUES = WINDOWS + """, vals as (select w.recording, w.k, w.t0, s.i, s.t_s, s.v, s.code from wins w join samples s on s.recording = w.recording and s.t_s >= w.t0 and s.t_s < w.t0 + 432000)"""
MATRIX = VALUES + """, stepped as (select *, abs(v - lag(v) over (partition by recording, k order by i)) as step from vals),
fm as (select recording as subject, recording || ':' || k as window_id, k, cast(5 * count(*) filter (code = 'purchase') > count(*) as int) as y, count(*) as n, avg(v) as f_mean, case when count(*) >= 6 then stddev_samp(v) end as f_sd, quantile_cont(v, 0.5) as f_median, avg(step) as f_step, max(v) as f_max from stepped group by recording, k),
m15 as (select * from fm),
med as (select a.subject as test_subject, quantile_cont(b.f_mean, 0.5) as median_f_mean, quantile_cont(b.f_sd, 0.5) as median_f_sd, quantile_cont(b.f_median, 0.5) as median_f_median, quantile_cont(b.f_step, 0.5) as median_f_step, quantile_cont(b.f_max, 0.5) as median_f_max from (select distinct subject from m15) a join m15 b on a.subject <> b.subject group by a.subject)"""
VOTES = MATRIX + """, voted as (select m.subject, m.window_id, m.y, cast({sign} * (
 case when f_mean is null then 0 when coalesce(f_mean > median_f_mean, false) then 1 else -1 end + case when f_sd is null then 0 when coalesce(f_sd > median_f_sd, false) then -1 else 1 end
 + case when f_median is null then 0 when coalesce(f_median > median_f_median, false) then 1 else -1 end + case when f_step is null then 0 when coalesce(f_step > median_f_step, false) then -1 else 1 end) as int) as vote from m15 m join med on m.subject = med.test_subject)"""
SIG = """sig as (select vec_id, 'S' || (vec_id % 20) as subject, 'seg' || label as seg_name, vec_id * 30.0::double as t0, 'S' || (vec_id % 20) || ':seg' || label || ':' || lpad(cast(vec_id as varchar), 8, '0') as window_id, cast(label >= 5 as int) as y, cast(embedding as double[]) as x from embeddings)"""
SCORED = """scored0 as (select source as subject, cast(d.doc_id as varchar) as window_id, quality as y, -(n_chars % 97) / 97.0::double as a, -(n_chars % 89) / 89.0::double as b, -((d.doc_id * 7919) % 97) / 97.0::double as a2, -((d.doc_id * 104729) % 89) / 89.0::double as b2, d.doc_id % 50 = 0 as failure from documents d join labels l on d.doc_id = l.doc_id),
scored as (select *, case when not failure then cast(b > a as int) end as yhat, case when not failure then cast(b2 > a2 as int) end as yhat2 from scored0),
ok as (select *, b - a as margin, b2 - a2 as margin2 from scored where not failure)"""


def counts(y: str = "y", p: str = "yhat", suffix: str = "") -> str:
    return ", ".join(f"count(*) filter ({y} = {i} and {p} = {j}) as {n}{suffix}" for n, i, j in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))


def f1(s: str = "", f: str = "{}") -> str:
    tp, fp, fn, tn = (f.format(n + s) for n in ("tp", "fp", "fn", "tn"))
    return f"((case when 2 * {tp} + {fp} + {fn} > 0 then cast(2 * {tp} as double) / (2 * {tp} + {fp} + {fn}) else 0 end + case when 2 * {tn} + {fp} + {fn} > 0 then cast(2 * {tn} as double) / (2 * {tn} + {fp} + {fn}) else 0 end) / nullif(cast(2 * {tp} + {fp} + {fn} > 0 as int) + cast(2 * {tn} + {fp} + {fn} > 0 as int), 0))"


def bits(*parts: str) -> str:
    return "cast('0x' || substr(md5(" + " || ':' || ".join(f"cast({p} as varchar)" for p in parts) + "), 1, 8) as bigint)"


def floor_sql(given: str, keys: str, reps: int = 1000) -> str:
    """The matched floor of counts a subject (given: a table with the keys, subject, tp, fp, fn, tn): hypergeometric draws."""
    return f"""hyp as (select {keys}, subject, tp + fp + fn + tn as n, tp + fn as ones, tp + fp as picked, greatest(0, tp + fn + tp + fp - (tp + fp + fn + tn)) as low, least(tp + fn, tp + fp) as high from {given}),
sup as (select *, unnest(generate_series(cast(low as bigint), cast(high as bigint))) as t from hyp),
lw as (select *, sum(case when t = low then 0.0::double else ln((ones - t + 1) * (picked - t + 1) / (t * (n - ones - picked + t))::double) end) over (partition by {keys}, subject order by t) as lw from sup),
wt as (select *, exp(lw - max(lw) over (partition by {keys}, subject)) as w from lw),
cdf as (select *, sum(w) over (partition by {keys}, subject order by t) / sum(w) over (partition by {keys}, subject) as c from wt),
hits as (select {keys}, subject, rep, any_value(n) as n, any_value(ones) as ones, any_value(picked) as picked, min(t) as hit from cdf cross join (select unnest(generate_series(0, {reps - 1})) as rep) where c >= ({bits('1337', 'rep', 'subject')} + 0.5) / 4294967296.0::double or t = high group by {keys}, subject, rep),
fl as (select {keys}, avg(v) as floor_mean, quantile_cont(v, 0.95) as floor_p95 from (select {keys}, {f1()} as v from (select {keys}, rep, sum(hit) as tp, sum(picked - hit) as fp, sum(ones - hit) as fn, sum(n - ones - picked + hit) as tn from hits group by {keys}, rep)) group by {keys})"""


FLOOR = floor_sql("st0", "g")
BA = "(tp / nullif(cast(tp + fn as double), 0) + tn / nullif(cast(tn + fp as double), 0)) / 2"
GATED = "case when ci_lo > chance then (macro_f1 - macro_f1_surr) / (macro_f1 - chance) end"
SUBJECTS = "idx as (select *, row_number() over (order by subject) - 1 as idx, count(*) over () as n_keys from st), draws as (select rep, " + bits("1337", "rep", "k") + " % n_keys as idx from (select unnest(generate_series(0, 999)) as rep) cross join (select idx as k, n_keys from idx))"
ANCHOR = "anchor as (select doc_id, text as body, cast(doc_id % 5 + 1 as int) as label, regexp_extract(text, '-?\\d+(?:\\.\\d+)?', 0) as found from documents), preds as (select *, try_cast(nullif(found, '') as double) as pred from anchor)"
DONORS = """blk as (select {c} subject, count(*) as own from sig group by {c} subject),
blocks as (select *, coalesce(cast(sum(own) over ({p} order by subject rows between unbounded preceding and 1 preceding) as bigint), 0) as a, cast(sum(own) over ({p}) as bigint) as n_all from blk),
placed as (select s.window_id, s.y, b.own, b.a, b.n_all, b.a + row_number() over (partition by {c} subject order by window_id) - 1 as at from sig s join blocks b using ({c} subject)),
drawn as (select window_id, y, a, own, """ + bits("1337", "window_id") + """ % (n_all - own) as d from placed where n_all > own),
pairs as (select w.window_id, p.window_id as donor from (select window_id, y, case when d < a then d else d + own end as at from drawn) w join placed p on w.at = p.at {j})"""
BROKEN = SIG + ", " + DONORS.format(c="", p="", j="")
PRESERVED = SIG + ", " + DONORS.format(c="y,", p="partition by y", j="and w.y = p.y")
MID = "rank() over (partition by {k} order by {v}) + (count(*) over (partition by {k}, {v}) - 1) / 2.0::double"
def rounded(columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns.split())


def q(ctes: str, select: str) -> str:
    return f"with {ctes}{'' if select.startswith(',') else ' '}{select}"


SQL = {
    "label_runs": q(RUNS, "select recording, seg_id, start_s, end_s, cast(label as int) as label, seg_name from runs"),
    "segment_class_counts": q(RUNS, "select recording, count(*) as n_windows, count(*) filter (label = 0) as n_0, count(*) filter (label = 1) as n_1 from runs group by rollup (recording)"),
    "hopping_windows": q(WINDOWS, "select recording, k, round(t0, 6) as t0, label from wins"),
    "window_samples_range_join": q(VALUES, "select recording, k, count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(quantile_cont(v, 0.5), 6) as median from vals group by recording, k"),
    "window_manifest_rollup": q(WINDOWS, "select recording, count(*) as n_windows, count(*) filter (label = 0) as n_0, count(*) filter (label = 1) as n_1 from wins group by rollup (recording)"),
    "overlap_trim": q(SAMPLES, ", two as (select *, code as channel from samples where code in ('view', 'click')), sp as (select recording, channel, min(t_s) as low, max(t_s) as high from two group by 1, 2), sh as (select recording, max(low) as low, min(high) as high from sp group by 1) select two.recording, two.channel, count(*) as n, round(min(t_s), 6) as low, round(max(t_s), 6) as high from two join sh on two.recording = sh.recording and t_s between sh.low and sh.high group by 1, 2"),
    "finite_edge_trim": q(SAMPLES, ", e as (select recording, min(i) as low, max(i) as high from samples where code <> 'error' group by 1) select s.recording, count(*) as n, min(i) as low, max(i) as high from samples s join e on s.recording = e.recording and s.i between e.low and e.high group by 1"),
    "clock_check": q(SAMPLES, ", st as (select *, t_s - lag(t_s) over (partition by recording order by i) as step from samples), g as (select recording, count(*) as n, quantile_cont(step, 0.5) as median_step from st group by 1) select recording, n, round(median_step, 6) as median_step, coalesce(abs(median_step - 28800) <= 0.25 * 28800, false) as ok from g"),
    "window_ids": q(SIG, "select vec_id, subject || ':' || seg_name || ':' || cast(cast(floor(round_even(t0 / 8 * 10, 0) / 10) as bigint) as varchar) || '.' || cast(cast(round_even(t0 / 8 * 10, 0) as bigint) % 10 as varchar) as id from sig"),
    "bin_mean_8": q(SIG, "select window_id, cast(b as int) as j, round(list_avg(x[b * 8 + 1 : b * 8 + 8]), 6) as v from sig, (select unnest(generate_series(0, 7)) as b)"),
    "uniform_stride_16": q(SIG, "select window_id, cast(b as int) as j, round(x[cast(round_even(b * 63 / 15.0::double, 0) as int) + 1], 6) as v from sig, (select unnest(generate_series(0, 15)) as b)"),
    "linear_resample_100": q(SIG, "select window_id, cast(b as int) as j, round(x[lo + 1] + (p - lo) * (x[least(lo + 1, 63) + 1] - x[lo + 1]), 6) as v from (select *, cast(floor(p) as int) as lo from (select *, b * 63 / 99.0::double as p from sig, (select unnest(generate_series(0, 99)) as b)))"),
    "prompt_vector_stats": q(SIG, ", v as (select window_id, b, list_avg(x[b * 8 + 1 : b * 8 + 8]) as v from sig, (select unnest(generate_series(0, 7)) as b)), s as (select *, abs(v - lag(v) over (partition by window_id order by b)) as st from v) select window_id, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd, round(avg(st), 6) as step from s group by 1"),
    "window_features": q(MATRIX, f"select subject, window_id, y, n, {rounded('f_mean f_sd f_median f_step f_max')} from fm"),
    "nan_report": q(MATRIX, " union all ".join(f"select '{c}' as feature, round(avg(cast({c} is null as int)), 6) as nan_rate from fm" for c in "f_mean f_sd f_median f_step f_max".split())),
    "rmssd_pnn50_from_intervals": q(SAMPLES, """, ibi as (select recording, i, 200 + 10 * v as b from samples), kept as (select * from ibi where b between 250 and 2000), d as (select *, b - lag(b) over (partition by recording order by i) as st from kept),
g as (select recording, count(*) as n, avg(b) as m, stddev_samp(b) as s, sqrt(avg(st * st)) as r, 100.0 * avg(cast(abs(st) > 50 as int)) as p from d group by 1)
select u.recording, round(case when n >= 4 then m end, 6) as hrv_mean_nn, round(case when n >= 4 then s end, 6) as hrv_sdnn, round(case when n >= 4 then r end, 6) as hrv_rmssd, round(case when n >= 4 then p end, 6) as hrv_pnn50, round(case when n >= 4 then 60000 / m end, 6) as hrv_mean_hr from (select distinct recording from samples) u left join g on u.recording = g.recording"""),
    "loso_folds": q(SIG, "select a.subject as test_subject, b.subject as train_subject from (select distinct subject from sig) a join (select distinct subject from sig) b on a.subject <> b.subject"),
    "loso_train_medians": q(MATRIX, f"select test_subject, {rounded('median_f_mean median_f_sd median_f_median median_f_step median_f_max')} from med"),
    "train_percentile": q(MATRIX, "select a.window_id, round(100.0 * avg(cast(round(b.f_mean, 9) <= round(a.f_mean, 9) as int)), 6) as percentile from m15 a join m15 b on a.subject <> b.subject where a.f_mean is not null and b.f_mean is not null group by 1"),
    "majority_per_fold": q(MATRIX, ", c as (select a.subject, b.y, count(*) as n from (select distinct subject from m15) a join m15 b on a.subject <> b.subject group by 1, 2) select subject as test_subject, y as majority, n as n_train from (select *, row_number() over (partition by subject order by n desc, y) as r from c) where r = 1"),
    "exemplars_stratified": q(SIG, f"select y, pick, window_id from (select *, row_number() over (partition by y order by {bits('1337', 'window_id')}, window_id) as pick from sig) where pick <= 4"),
    "dev_eval_split": q(SIG, f"select subject, case when row_number() over (order by {bits('1337', 'subject')}, subject) <= 2 then 'dev' else 'eval' end as role from (select distinct subject from sig)"),
    "train_complement": q(ANCHOR, "select doc_id, label from anchor where doc_id % 2 = 0 and body not in (select body from anchor where doc_id % 2 = 1)"),
    "leak_check": q(ANCHOR, "select count(*) as n_leaks from anchor where doc_id % 2 = 0 and body in (select body from anchor where doc_id % 2 = 1)"),
    "resume_todo": "with done as (select distinct o_orderkey % 40 as conv_id from orders), st as (select coalesce(max(conv_id) - min(conv_id) + 1 <> count(*), false) as gap from done) select distinct conv_id, gap from conversations, st where conv_id not in (select conv_id from done)",
    "macro_f1_rollup": q(SCORED, f", c as (select subject, count(*) as n, {counts()} from ok group by rollup (subject)) select subject, n, round({f1()}, 6) as macro_f1 from c"),
    "balanced_accuracy": q(SCORED, f", c as (select subject, {counts()} from ok group by rollup (subject)) select subject, round({BA}, 6) as balanced_accuracy from c"),
    "auroc_by_subject": q(SCORED, f", r as (select subject, y, {MID.format(k='subject', v='m')} as r from (select *, round(margin, 9) as m from ok)), g as (select subject, count(*) filter (y = 1) as n_pos, count(*) filter (y = 0) as n_neg, sum(r) filter (y = 1) as sr from r group by 1) select subject, n_pos, n_neg, round((sr - n_pos * (n_pos + 1) / 2.0::double) / nullif(cast(n_pos * n_neg as double), 0), 6) as auroc from g"),
    "margin_gate": q(SCORED, "select subject, count(*) as n, round(stddev_pop(margin), 6) as sd, count(*) >= 2 and stddev_pop(margin) > 0.126 as varies from ok group by 1"),
    "bootstrap_ci_macro_f1": q(SCORED, f", st as (select subject, {counts()} from ok group by 1), {SUBJECTS}, r as (select rep, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from draws join idx using (idx) group by rep), v as (select {f1()} as v from r) select round(quantile_cont(v, 0.025), 6) as ci_lo, round(quantile_cont(v, 0.975), 6) as ci_hi, count(v) as reps from v"),
    "auroc_ci": q(SCORED, f""", st as (select subject, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from ok group by 1), idx as (select *, row_number() over (order by subject) - 1 as idx, count(*) over () as n_keys from st),
draws as (select rep, {bits('1337', 'rep', 'k')} % n_keys as idx from (select unnest(generate_series(0, 999)) as rep) cross join (select idx as k, n_keys from idx)), t as (select rep, subject, count(*) as c, any_value(pos) as pos, any_value(neg) as neg from draws join idx using (idx) group by 1, 2),
w as (select a.subject as s, b.subject as t, sum(case when round(a.margin, 9) > round(b.margin, 9) then 1.0 when round(a.margin, 9) = round(b.margin, 9) then 0.5 else 0 end)::double as won from ok a join ok b on a.y = 1 and b.y = 0 group by 1, 2),
z as (select rep, cast(sum(c * pos) as double) * cast(sum(c * neg) as double) as pn from t group by 1), u as (select a.rep, sum(a.c * b.c * w.won) as u from t a join t b on a.rep = b.rep join w on w.s = a.subject and w.t = b.subject group by 1), v as (select u / nullif(pn, 0) as v from z left join u using (rep))
select round(quantile_cont(v, 0.025), 6) as ci_lo, round(quantile_cont(v, 0.975), 6) as ci_hi, count(v) as reps from v"""),
    "paired_delta_ci": q(SCORED, f", st as (select subject, {counts()}, {counts('y', 'yhat2', '2')} from ok group by 1), {SUBJECTS}, r as (select rep, " + ", ".join(f"sum({n}) as {n}" for n in "tp fp fn tn tp2 fp2 fn2 tn2".split()) + f" from draws join idx using (idx) group by rep), v as (select {f1()} - {f1('2')} as v from r) select round(quantile_cont(v, 0.025), 6) as ci_lo, round(quantile_cont(v, 0.975), 6) as ci_hi, count(v) as reps from v"),
    "flip_rate_ci": q(SCORED, f", st as (select subject, sum(cast(yhat <> yhat2 as int)) as flips, count(*) as n from ok group by 1), {SUBJECTS}, v as (select rep, sum(flips) / cast(sum(n) as double) as v from draws join idx using (idx) group by rep) select round(quantile_cont(v, 0.025), 6) as ci_lo, round(quantile_cont(v, 0.975), 6) as ci_hi, count(v) as reps from v"),
    "flip_rates": q(SCORED, "select subject, count(*) as n, round(avg(cast(yhat <> yhat2 as int)), 6) as flip_rate from ok group by rollup (subject)"),
    "matched_floor": q(SCORED, f", st0 as (select 0 as g, subject, {counts()} from ok group by subject), {FLOOR} select round(floor_mean, 6) as floor_mean, round(floor_p95, 6) as floor_p95 from fl"),
    "holm_adjust": "with p as (select s_suppkey, s_nationkey % 4 as family, case when s_suppkey % 7 <> 0 then (s_suppkey * 37 % 1009) / 10090.0::double end as p from supplier), w as (select *, row_number() over (partition by family order by p, s_suppkey) as r, count(*) over (partition by family) as m from p where p is not null), a as (select s_suppkey, family, p, least(1.0, max((m - r + 1) * p) over (partition by family order by r)) as p_holm from w union all select s_suppkey, family, p, null from p where p is null) select s_suppkey, family, round(p, 6) as p, round(p_holm, 6) as p_holm from a",
    "wilcoxon_statistic": q(SCORED, f", d as (select subject, margin - margin2 as d, round(abs(margin - margin2), 9) as m from ok where margin <> margin2), r as (select *, {MID.format(k='subject', v='m')} as r from d), g as (select subject, count(*) as n, sum(case when d > 0 then r else 0 end) as w_plus, sum(case when d < 0 then r else 0 end) as w_minus from r group by 1) select subject, n, round(w_plus, 6) as w_plus, round(w_minus, 6) as w_minus, round(least(w_plus, w_minus), 6) as statistic from g"),
    "spearman_by_subject": q(SCORED, f", t as (select subject, round(margin, 9) as u, round(margin2, 9) as v from ok), r as (select subject, {MID.format(k='subject', v='u')} as ru, {MID.format(k='subject', v='v')} as rv from t) select subject, count(*) as n, round(corr(ru, rv), 6) as spearman from r group by 1"),
    "pooled_moments": q(SIG, "select count(*) as n, round(avg(v), 6) as mean, round(var_pop(v), 6) as var from (select unnest(x) as v from sig)"),
    "flatline_windows": q(SIG, ", m as (select avg(v) as m from (select unnest(x) as v from sig)) select window_id, len(x) as n, round(m, 6) as low, round(m, 6) as high from sig, m"),
    "donor_broken": q(BROKEN, "select window_id, donor from pairs"),
    "donor_preserved": q(PRESERVED, "select window_id, donor from pairs"),
    "permuted_features": q(BROKEN, ", f as (select window_id, avg(v) as f_mean, stddev_pop(v) as f_sd from (select window_id, unnest(x) as v from sig) group by 1) select s.subject, s.window_id, s.y, p.donor, round(f.f_mean, 6) as f_mean, round(f.f_sd, 6) as f_sd from sig s join pairs p using (window_id) join f on f.window_id = p.donor"),
    "adjective_vote_i": q(VOTES.format(sign=1), "select window_id, y, vote, cast(vote > 0 as int) as yhat from voted"),
    "adjective_vote_iii": q(VOTES.format(sign=-1), "select window_id, y, vote, cast(vote > 0 as int) as yhat from voted"),
    "argmax_label": q(SCORED, "select window_id, case when cast(window_id as bigint) % 11 <> 0 then cast(b > a as int) else -1 end as yhat from scored"),
    "condition_summary": q(SCORED, f", c as (select subject, count(*) filter (not failure) as n_scored, count(*) filter (failure) as n_failures, {counts()} from scored group by 1) select subject, n_scored, n_failures, round({f1()}, 6) as macro_f1 from c"),
    "first_number_mae": q(ANCHOR, "select label, count(*) as n, count(pred) as parsed, count(*) - count(pred) as failures, round(avg(abs(pred - label)), 6) as mae from preds group by label"),
    "label_distribution": q(ANCHOR, "select try_cast(nullif(regexp_extract(body, 'is (\\d+)', 1), '') as int) as label, count(*) as n, round(avg(abs(3 - try_cast(nullif(regexp_extract(body, 'is (\\d+)', 1), '') as int))), 6) as constant_mae from anchor group by 1"),
    "bracket_list_mean": q(SAMPLES, "select recording, count(*) as n, round(avg(round(v, 2)), 4) as mean from samples group by 1"),
    "seed_aggregate": q(ANCHOR, ", p as (select doc_id % 3 as seed, avg(abs(pred - label)) as mae from preds group by 1) select count(*) as seeds, round(avg(mae), 6) as mean, round(coalesce(stddev_samp(mae), 0), 6) as sd from p"),
    "verbalize_logic": q(MATRIX, "select window_id, case when f_mean is null then 'unavailable' when f_mean > median_f_mean then 'elevated' else 'reduced' end as state_f_mean, case when f_sd is null then 'unavailable' when f_sd > median_f_sd then 'elevated' else 'reduced' end as state_f_sd from m15 join med on subject = test_subject"),
    "prompt_render": q(SIG, "select window_id, 'Classify this physiological recording.' || chr(10) || 'A = calm. B = stress. Answer with a single token, A or B.' || chr(10) || 'Examples:' || chr(10) || 'first' || chr(10) || 'Answer: A' || chr(10) || 'second' || chr(10) || 'Answer: B' || chr(10) || chr(10) || 'subject ' || subject || ' part ' || seg_name || chr(10) || 'Answer:' as prompt from sig"),
    "zero_shot_prompts": q(ANCHOR, f"select doc_id, sha256('Read the text.' || chr(10) || body || 'For example, the answer should be in the following format:' || chr(10) || 'Answer: ' || cast({bits('1337', 'doc_id')} % 6 as varchar)) as prompt_sha256 from anchor"),
    "content_hash": f"select count(*) as n, cast(sum({bits("concat_ws('|', doc_id, text, lang, source, n_chars)")}) as bigint) as hash from documents",
}
