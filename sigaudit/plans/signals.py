"""Queries over windows of several channels, locks and decoding steps, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import frame, ladder, locks, multirate
from ..schemas import PLAN, RUNGS, feature_columns
from ..sources import adapters as src
from .oracle import MATRIX, SAMPLES, SIG, bits

SEED = 1337
#: Rates of the channels that are made of the 64 samples of a window.
RATES = {"ecg": 64.0, "eda": 4.0, "resp": 4.0, "bvp": 64.0, "ppg": 64.0}


def _r6(c, name: str):
    return F.round(c, 6).alias(name)


def _channels(s, d) -> DataFrame:
    """Windows with heart channels of 256 samples, the 64 samples as breath, and as skin but for windows of label 0; those of label 1 have
    a sample missing there."""
    e = src.table(s, d, "embeddings")
    w = src.sig_windows(s, d).join(e.select("vec_id", "label"), "vec_id")
    x = F.col("x")
    long = F.concat(x, x, x, x)
    gap = F.transform(x, lambda v, i: F.when((F.col("label") != 1) | (i != 9), v))
    fixed = F.create_map(F.lit("ecg"), long, F.lit("bvp"), long, F.lit("ppg"), long, F.lit("resp"), x)
    return w.select("window_id", "subject", "y", F.when(F.col("label") == 0, fixed).otherwise(F.map_concat(fixed, F.create_map(F.lit("eda"), gap))).alias("channels"))


def feature_frame(s, d):
    """The feature frame of all three plans: columns in order, level and what is missing of each family that SQL can tell."""
    w, out = _channels(s, d), None
    for dataset, families in PLAN.items():
        f = frame.build_feature_frame(w, dataset, RATES)
        names = ",".join(c for c in f.columns if c in feature_columns(dataset))
        missing = lambda family: sum((F.col(c).isNull().cast("int") for c in frame.FAMILIES[family]), F.lit(0)) if family in families else F.lit(None).cast("int")  # noqa: B023, E731
        level = lambda c: _r6(F.col(c), c) if c in f.columns else F.lit(None).cast("double").alias(c)  # noqa: B023, E731
        spectrum = F.col("hrv_lf").isNull() & F.col("hrv_hf").isNull() & F.col("hrv_lf_hf").isNull()
        one = f.select(F.lit(dataset).alias("dataset"), "window_id", "subject", "y", F.lit(names).alias("columns"), missing("eda").alias("eda_missing"), level("eda_level_mean"), level("eda_level_std"), spectrum.alias("spectrum_missing"))
        out = one if out is None else out.unionByName(one)
    return out


def feature_frame_gaps(s, d):
    """How much of the frame of the widest plan is missing, by feature family of skin conductance."""
    f = frame.build_feature_frame(_channels(s, d), "wesad", RATES)
    return frame.missing_report(f, list(frame.FAMILIES["eda"])).select("feature", "n", _r6(F.col("missing"), "missing"), "empty")


def _unequal(s, d) -> DataFrame:
    """Windows of two channels; those of half the subjects have the slow one at half the rate."""
    w = src.sig_windows(s, d)
    slow = F.when(F.col("vec_id") % 2 == 0, arrays.bin_mean(F.col("x"), 8)).otherwise(arrays.bin_mean(F.col("x"), 16))
    return w.select("window_id", "subject", "y", F.create_map(F.lit("fast"), F.col("x"), F.lit("slow"), slow).alias("channels"))


def surrogate_ladder(s, d):
    """Every rung's windows: length, mean and deviation of each channel. Noise has its length only."""
    w, out = _unequal(s, d), None
    for rung in RUNGS:
        made = ladder.apply_surrogate(w, rung, SEED)
        if made is None:
            one = w.select(F.lit(rung).alias("rung"), "window_id", F.lit(None).cast("string").alias("channel"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("sd"))
        else:
            told = F.lit(rung != "gaussian")
            rows = made.select("window_id", F.explode("channels").alias("channel", "x"))
            one = rows.select(F.lit(rung).alias("rung"), "window_id", "channel", F.size("x").alias("n"), F.when(told, F.round(arrays.mean(F.col("x")), 6)).alias("mean"), F.when(told, F.round(arrays.sd(F.col("x")), 6)).alias("sd"))
        out = one if out is None else out.unionByName(one)
    return out


#: A window of 16 s every 8 s, of channels at 1 and half a sample a second.
CUT_RATES, CUT_WIDTH, CUT_STRIDE = {"all": 1.0, "half": 0.5}, 16.0, 8.0


def _cut(s, d) -> DataFrame:
    v = src.samples(s, d)
    value = F.when(F.col("code") != "error", F.col("v"))
    samples = v.select("recording", F.lit("all").alias("channel"), "i", value.alias("v")).unionByName(v.where("i % 2 = 0").select("recording", F.lit("half").alias("channel"), (F.col("i") / 2).cast("bigint").alias("i"), value.alias("v")))
    ends = v.groupBy("recording").agg((F.max("i") + 1).alias("n"))
    windows = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / CUT_STRIDE).cast("int")))).select("recording", "k", (F.col("k") * CUT_STRIDE + 0.5).alias("t0"))
    return multirate.cut(samples, windows, CUT_RATES, CUT_WIDTH)


def multirate_cut(s, d):
    """Windows of two channels at their own rates, and why those that are not whole are dropped."""
    at = lambda c: F.try_element_at("channels", F.lit(c))
    mean = lambda c: F.aggregate(at(c), F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(at(c))
    size = lambda c: F.when(at(c).isNotNull(), F.size(at(c)))
    return _cut(s, d).select("recording", "k", "t0", "dropped", size("all").alias("n_all"), size("half").alias("n_half"), F.round(mean("all"), 4).alias("mean_all"), F.round(mean("half"), 4).alias("mean_half"))


def multirate_drops(s, d):
    return multirate.drops(_cut(s, d))


def window_lookup(s, d):
    """Windows found by segment and time to a thousandth of a second; every fifth is wanted too far off."""
    w = src.sig_windows(s, d)
    wanted = w.select("vec_id", "seg_name", (F.col("t0") + (F.col("vec_id") % 5 - 2) * F.lit(0.0006)).alias("t0"))
    looked = multirate.lookup(wanted, w.select("seg_name", "t0", "window_id"), ["seg_name"])
    return looked.select("vec_id", "seg_name", F.col("found.window_id").alias("window_id"))


def subject_exclusions(s, d):
    return multirate.exclusions(src.feature_matrix(s, d), 2)


def content_digest(s, d):
    """The sums that a lock of the documents is told by."""
    return locks.row_sums(src.table(s, d, "documents")).select("n", *(F.col(f"s{i}").cast("string").alias(f"s{i}") for i in range(locks.PARTS)))


#: Texts that a decoding step lists in turn, and the labels' (fixed values).
TOKENS, LABELS = ("A", " B", "▁a", "b ", "C", "The", "ĠB", " a"), {"a": "A", "b": "B"}


def _steps(s, d) -> DataFrame:
    """Decoding steps: of each vector five of TOKENS with its components as log probabilities; one in seven is not finite."""
    e = src.table(s, d, "embeddings")
    token = F.array(*(F.lit(t) for t in TOKENS))
    step = lambda i: F.struct(F.get(token, ((F.col("vec_id") * 3 + i * (1 + F.col("vec_id") % 4)) % len(TOKENS)).cast("int")).alias("token"), F.when((F.col("vec_id") + i) % 7 != 0, -F.abs(F.get("embedding", i).cast("double"))).otherwise(F.lit(float("-inf"))).alias("logprob"))
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(4)), step).alias("steps"))


def label_logprobs_of_steps(s, d):
    """The labels' log probabilities out of decoding steps."""
    return locks.scored_steps(_steps(s, d), "steps", LABELS).select("vec_id", _r6(F.col("logprob_a"), "logprob_a"), _r6(F.col("logprob_b"), "logprob_b"), "failure", "yhat")


QUERIES = {f.__name__: f for f in (feature_frame, feature_frame_gaps, surrogate_ladder, multirate_cut, multirate_drops, window_lookup, subject_exclusions, content_digest, label_logprobs_of_steps)}

_SKIN = "skin as (select s.*, e.label, case when e.label = 0 then 7 when e.label = 1 then 7 else 0 end as gone from sig s join embeddings e using (vec_id))"
_FRAME = " union all ".join(
    f"select '{dataset}' as dataset, window_id, subject, y, '{','.join(feature_columns(dataset))}' as columns, {'gone' if 'eda' in families else 'cast(null as int)'} as eda_missing, "
    + ", ".join(f"{f'case when gone = 0 then round({agg}, 6) end' if 'eda' in families else 'cast(null as double)'} as {name}" for name, agg in (("eda_level_mean", "list_avg(x)"), ("eda_level_std", "list_stddev_samp(x)")))
    + ", true as spectrum_missing from skin"
    for dataset, families in PLAN.items()
)
_EDA = [c for c in feature_columns("cogwear") if c.startswith("eda")]
_GAPS = " union all ".join(f"select {f} as feature, count(*) as n, round(avg(cast(gone > 0 as int)), 6) as missing, {e} as empty from skin" for f, e in [*((f"'{c}'", "cast(null as bigint)") for c in _EDA), ("cast(null as varchar)", "count(*) filter (gone > 0)")])
_SLOW = "list_transform(range(0, {n}), lambda b: list_avg(list_slice(x, b * {w} + 1, b * {w} + {w})))"
_UNEQUAL = f"""uneq as (select vec_id, window_id, subject, y, unnest(['fast', 'slow']) as channel, unnest([x, case when vec_id % 2 = 0 then {_SLOW.format(n=8, w=8)} else {_SLOW.format(n=16, w=4)} end]) as x from sig)"""


def _donors(keys: str) -> str:
    by = f"partition by {keys}" if keys else ""
    same = f"and w.{keys} = p.{keys}" if keys else ""
    return f"""parted as (select window_id, subject, y, {bits("'part'", "window_id")} % 65536 as part from sig),
placed as (select *, row_number() over ({by} order by subject, part, window_id) - 1 as spot, count(*) over ({by}) as every from parted),
own as (select *, min(spot) over (partition by {keys + ', ' if keys else ''}subject) as a, count(*) over (partition by {keys + ', ' if keys else ''}subject) as own from placed),
drawn as (select *, {bits("1337", "window_id")} % (every - own) as d from own),
pairs as (select w.window_id, p.window_id as donor from (select window_id, y, case when d < a then d else d + own end as want from drawn) w join placed p on w.want = p.spot {same}),
given as (select u.window_id, u.channel, len(u.x) as n, g.x from uneq u join pairs using (window_id) join uneq g on g.window_id = pairs.donor and g.channel = u.channel),
moved as (select window_id, channel, n, case when len(x) = n then x else list_transform(range(0, n), lambda j: x[cast(floor(j * (len(x) - 1) / greatest(n - 1, 1)::double) as int) + 1]
  + (j * (len(x) - 1) / greatest(n - 1, 1)::double - floor(j * (len(x) - 1) / greatest(n - 1, 1)::double)) * (x[least(cast(floor(j * (len(x) - 1) / greatest(n - 1, 1)::double) as int) + 1, len(x) - 1) + 1] - x[cast(floor(j * (len(x) - 1) / greatest(n - 1, 1)::double) as int) + 1])) end as x from given)"""


_TOLD = "cast(len(x) as int) as n, round(list_avg(x), 6) as mean, round(list_stddev_pop(x), 6) as sd"
_MOVED = "select '{rung}' as rung, window_id, channel, cast(n as int) as n, round(list_avg(x), 6) as mean, round(list_stddev_pop(x), 6) as sd from (with {donors} select * from moved)"
_LADDER = f"""select 'gaussian' as rung, window_id, channel, cast(len(x) as int) as n, cast(null as double) as mean, cast(null as double) as sd from uneq
union all select 'iaaft', window_id, channel, {_TOLD} from uneq
union all select 'flatline', window_id, channel, cast(len(x) as int), round(m, 6), 0.0::double from uneq join (select channel, avg(v) as m from (select channel, unnest(x) as v from uneq) group by channel) using (channel)
union all select 'deleted', window_id, null, 0, null, null from sig
union all {_MOVED.format(rung="subject_perm_broken", donors=_donors(""))}
union all {_MOVED.format(rung="subject_perm_preserved", donors=_donors("y"))}"""
_CUT = (
    SAMPLES
    + """, vals as (select recording, 'all' as channel, i, case when code <> 'error' then v end as v from samples
  union all select recording, 'half', i // 2, case when code <> 'error' then v end from samples where i % 2 = 0),
wins as (select recording, k, k * 8 + 0.5::double as t0 from (select recording, unnest(generate_series(0, cast(floor((max(i) + 1) / 8.0) as bigint))) as k from samples group by recording)),
spans as (select recording, k, t0, unnest(['all', 'half']) as channel, unnest([cast(round_even(t0, 0) as bigint), cast(round_even(t0 * 0.5, 0) as bigint)]) as first, unnest([16, 8]) as size from wins),
parts as (select s.recording, s.k, s.t0, s.channel, s.size, count(v.i) as n, count(*) filter (v.i is not null and v.v is null) as bad, avg(v.v::float::double) as m from spans s left join vals v on v.recording = s.recording and v.channel = s.channel and v.i >= s.first and v.i < s.first + s.size group by all),
cut as (select recording, k, t0, case when min(cast(n = size as int)) = 0 then 'short' when sum(bad) > 0 then 'not finite' end as dropped, max(m) filter (channel = 'all') as mean_all, max(m) filter (channel = 'half') as mean_half from parts group by all)"""
)
_PLAIN = "lower(trim(regexp_replace(t, '^[▁Ġ\\s]+|\\s+$', '', 'g')))"
_STEPS = f"""steps as (select vec_id, i, [{', '.join(f"'{t}'" for t in TOKENS)}][(vec_id * 3 + i * (1 + vec_id % 4)) % {len(TOKENS)} + 1] as t, case when (vec_id + i) % 7 <> 0 then -abs(embedding[i + 1]::double) end as p from (select *, unnest(range(0, 5)) as i from embeddings)),
best as (select vec_id, round(max(p) filter ({_PLAIN} = 'a'), 6) as logprob_a, round(max(p) filter ({_PLAIN} = 'b'), 6) as logprob_b from steps group by vec_id)"""
_FIELD = "coalesce(len({c}::varchar) || ':' || {c}::varchar, '-')"
_ROW = " || ".join(_FIELD.format(c=c) for c in sorted(("doc_id", "text", "lang", "source", "n_chars")))
SQL = {
    "feature_frame": f"with {SIG}, {_SKIN} {_FRAME}",
    "feature_frame_gaps": f"with {SIG}, {_SKIN} {_GAPS}",
    "surrogate_ladder": f"with {SIG}, {_UNEQUAL} {_LADDER}",
    "multirate_cut": f"with {_CUT} select recording, cast(k as int) as k, t0, dropped, case when dropped is null then 16 end as n_all, case when dropped is null then 8 end as n_half, case when dropped is null then round(mean_all, 4) end as mean_all, case when dropped is null then round(mean_half, 4) end as mean_half from cut",
    "multirate_drops": f"with {_CUT} select recording, count(*) as n_windows, count(*) filter (dropped is null) as n_kept, count(*) filter (dropped = 'short') as n_short, count(*) filter (dropped = 'not finite') as n_not_finite from cut group by rollup (recording)",
    "window_lookup": f"with {SIG} select w.vec_id, w.seg_name, g.window_id from (select *, t0 + (vec_id % 5 - 2) * 0.0006::double as want from sig) w left join sig g on g.seg_name = w.seg_name and abs(g.t0 - w.want) <= 0.001",
    "subject_exclusions": f"with {MATRIX} select subject, count(*) as n, count(*) filter (y = 0) as n_0, count(*) filter (y = 1) as n_1, case when count(*) filter (y = 0) < 2 or count(*) filter (y = 1) < 2 then 'class' end as excluded from fm group by subject",
    "content_digest": "select count(*) as n, " + ", ".join(f"cast(sum(cast('0x' || substr(h, {16 * i + 1}, 15) as hugeint)) as varchar) as s{i}" for i in range(4)) + f" from (select sha256({_ROW}) as h from documents)",
    "label_logprobs_of_steps": f"with {_STEPS} select vec_id, logprob_a, logprob_b, logprob_a is null or logprob_b is null as failure, case when logprob_a is not null and logprob_b is not null then cast(logprob_b > logprob_a as int) end as yhat from best",
}
