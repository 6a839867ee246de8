"""The registered audit queries over the adapter views (their DuckDB SQL is in oracle.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import anchor_text, arrays, dsp, metrics, png, rng, text
from ..operators import folds, models, report, scoring, surrogates, windowing
from ..sources import adapters as src

SEED, REPS = 1337, 1000
VOTE_FEATURES = {"f_mean": "eda_level_mean", "f_sd": "hrv_sdnn", "f_median": "eda_tonic_mean", "f_step": "hrv_rmssd", "f_max": "hrv_lf"}
FEATURES = list(src.FEATURES)


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def exploded(df: DataFrame, x) -> DataFrame:
    return df.select("window_id", F.posexplode(x).alias("j", "v")).select("window_id", "j", r6("v", "v"))


def matrix(s, d) -> DataFrame:
    return src.feature_matrix(s, d)


# segments and windows


def label_runs(s, d):
    return windowing.label_runs(src.samples(s, d), src.POSITIVE, src.NEGATIVE)


def segment_class_counts(s, d):
    return windowing.manifest(label_runs(s, d))


def hopping_windows(s, d):
    return src.ev_windows(s, d).select("recording", "k", r6("t0", "t0"), "label")


def window_samples_range_join(s, d):
    w = src.window_values(s, d)
    return w.groupBy("recording", "k").agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"), r6(F.stddev_samp("v"), "sd"), r6(F.expr("percentile(v, 0.5)"), "median"))


def window_manifest_rollup(s, d):
    return windowing.manifest(src.ev_windows(s, d))


def overlap_trim(s, d):
    two = src.samples(s, d).where(F.col("code").isin("view", "click")).withColumn("channel", F.col("code"))
    return windowing.overlap(two).groupBy("recording", "channel").agg(F.count("*").alias("n"), r6(F.min("t_s"), "low"), r6(F.max("t_s"), "high"))


def finite_edge_trim(s, d):
    gaps = src.samples(s, d).withColumn("v", F.when(F.col("code") != "error", F.col("v")))
    return windowing.finite_edges(gaps).groupBy("recording").agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"))


def clock_check(s, d):
    return windowing.clock_check(src.samples(s, d), 1 / 28800.0, 0.25).select("recording", "n", r6("median_step", "median_step"), "ok")


def window_ids(s, d):
    w = src.sig_windows(s, d)
    return w.select("vec_id", windowing.window_id(F.col("subject"), F.col("seg_name"), F.col("t0") / 8).alias("id"))


# arrays and features


def bin_mean_8(s, d):
    return exploded(src.sig_windows(s, d), arrays.bin_mean(F.col("x"), 8))


def uniform_stride_16(s, d):
    return exploded(src.sig_windows(s, d), arrays.uniform_stride(F.col("x"), 16))


def linear_resample_100(s, d):
    return exploded(src.sig_windows(s, d), arrays.linear_resample(F.col("x"), 100))


def prompt_vector_stats(s, d):
    v = src.prompt_vectors(s, d)
    return v.select("window_id", r6(arrays.mean(F.col("x")), "mean"), r6(arrays.sd(F.col("x")), "sd"), r6(arrays.mean_abs_difference(F.col("x")), "step"))


def window_features(s, d):
    m = src.feature_matrix(s, d)
    return m.select("subject", "window_id", "y", "n", *(r6(c, c) for c in FEATURES))


def nan_report(s, d):
    m = src.feature_matrix(s, d)
    gaps = m.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in FEATURES))
    return gaps.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), r6(c, "nan_rate")) for c in FEATURES))).alias("r")).select("r.*")


def rmssd_pnn50_from_intervals(s, d):
    h = src.intervals(s, d).select("recording", arrays.hrv_time(F.col("ibi")).alias("h")).select("recording", "h.*")
    return h.select("recording", *(r6(c, c) for c in h.columns if c != "recording"))


def hrv_welch_bands(s, d):
    return src.intervals(s, d).select("recording", dsp.hrv_bands_of("ibi").alias("h")).select("recording", "h.*")


def heart_window_features(s, d):
    return src.sig_windows(s, d).select("window_id", dsp.heart_features("x", F.lit(4.0)).alias("h")).select("window_id", "h.*")


def scr_peaks(s, d):
    return src.sig_windows(s, d).select("window_id", dsp.skin_features("x", F.lit(4.0)).alias("h")).select("window_id", "h.*")


def resp_features(s, d):
    return src.sig_windows(s, d).select("window_id", dsp.breath_features("x", F.lit(1.0)).alias("h")).select("window_id", "h.*")


# folds


def loso_folds(s, d):
    return folds.loso(src.sig_windows(s, d))


def loso_train_medians(s, d):
    m = folds.train_medians(matrix(s, d), FEATURES)
    return m.select("test_subject", *(r6(f"median_{c}", f"median_{c}") for c in FEATURES))


def train_percentile(s, d):
    p = folds.train_percentile(matrix(s, d), "f_mean")
    return p.select("window_id", r6("percentile", "percentile"))


def majority_per_fold(s, d):
    return folds.majority(matrix(s, d))


def exemplars_stratified(s, d):
    return folds.exemplars(src.sig_windows(s, d), 8, SEED).select("y", F.col("pick").cast("bigint").alias("pick"), "window_id")


def dev_eval_split(s, d):
    return folds.dev_split(src.sig_windows(s, d), 2, SEED)


def _anchor(s, d):
    t = src.table(s, d, "documents")
    return t.select("doc_id", F.col("text").alias("body"), (F.col("doc_id") % 5 + 1).cast("int").alias("label"))


def train_complement(s, d):
    a = _anchor(s, d)
    return folds.complement(a.where("doc_id % 2 = 0"), a.where("doc_id % 2 = 1"), "body").select("doc_id", "label")


def leak_check(s, d):
    a = _anchor(s, d)
    return folds.leaks(a.where("doc_id % 2 = 0"), a.where("doc_id % 2 = 1"), "body").agg(F.count("*").alias("n_leaks"))


def resume_todo(s, d):
    c = src.table(s, d, "conversations").select("conv_id").distinct()
    o = src.table(s, d, "orders").select((F.col("o_orderkey") % 40).alias("conv_id")).distinct()
    return folds.resume(c, o, "conv_id")


# metrics


def macro_f1_rollup(s, d):
    return metrics.macro_f1_rollup(src.scored(s, d)).select("subject", "n", r6("macro_f1", "macro_f1"))


def balanced_accuracy(s, d):
    c = metrics.usable(src.scored(s, d)).rollup("subject").agg(*metrics.confusion())
    return c.select("subject", r6(metrics.balanced_accuracy(), "balanced_accuracy"))


def auroc_by_subject(s, d):
    a = metrics.auroc(metrics.usable(src.scored(s, d)).withColumn("m", F.round(metrics.margin(), 9)), "m", ["subject"])
    return a.select("subject", "n_pos", "n_neg", r6("auroc", "auroc"))


def margin_gate(s, d):
    m = metrics.usable(src.scored(s, d)).groupBy("subject").agg(F.count("*").alias("n"), F.stddev_pop(metrics.margin()).alias("sd"))
    return m.select("subject", "n", r6("sd", "sd"), ((F.col("n") >= 2) & (F.col("sd") > 10 * F.greatest(F.lit(0.0126), F.lit(0.01)))).alias("varies"))


def _stats(rows):
    return metrics.usable(rows).groupBy("subject").agg(*metrics.confusion(), F.count("*").alias("n"))


def bootstrap_ci_macro_f1(s, d):
    reps = metrics.bootstrap(_stats(src.scored(s, d)), ["tp", "fp", "fn", "tn"], REPS, SEED)
    return metrics.interval(reps, metrics.macro_f1()).select(r6("ci_lo", "ci_lo"), r6("ci_hi", "ci_hi"), "reps")


def auroc_ci(s, d):
    rows = metrics.usable(src.scored(s, d)).withColumn("m", F.round(metrics.margin(), 9))
    return metrics.interval(metrics.auroc_bootstrap(rows, "m", REPS, SEED), F.col("auroc")).select(r6("ci_lo", "ci_lo"), r6("ci_hi", "ci_hi"), "reps")


def paired_delta_ci(s, d):
    a = report.aligned(src.scored(s, d), src.scored(s, d, True))
    c = a.groupBy("subject").agg(*metrics.confusion(), *(x.alias(n) for x, n in zip(metrics.confusion("y", "yhat_surr"), ("tp2", "fp2", "fn2", "tn2"), strict=True)))
    reps = metrics.bootstrap(c, ["tp", "fp", "fn", "tn", "tp2", "fp2", "fn2", "tn2"], REPS, SEED)
    return metrics.interval(reps, metrics.macro_f1() - metrics.macro_f1("tp2", "fp2", "fn2", "tn2")).select(r6("ci_lo", "ci_lo"), r6("ci_hi", "ci_hi"), "reps")


def flip_rate_ci(s, d):
    f = report.flips(src.scored(s, d), src.scored(s, d, True)).groupBy("subject").agg(F.sum("flipped").alias("flips"), F.count("*").alias("n"))
    reps = metrics.bootstrap(f, ["flips", "n"], REPS, SEED)
    return metrics.interval(reps, F.col("flips") / F.col("n")).select(r6("ci_lo", "ci_lo"), r6("ci_hi", "ci_hi"), "reps")


def flip_rates(s, d):
    f = report.flips(src.scored(s, d), src.scored(s, d, True))
    return f.rollup("subject").agg(F.count("*").alias("n"), r6(F.avg("flipped"), "flip_rate"))


def matched_floor(s, d):
    counts = metrics.usable(src.scored(s, d)).groupBy("subject").agg(*metrics.confusion()).withColumn("g", F.lit(0))
    return metrics.matched_floor(counts, ["g"], REPS, SEED).select(r6("floor_mean", "floor_mean"), r6("floor_p95", "floor_p95"))


def _p_values(s, d):
    t = src.table(s, d, "supplier")
    return t.select("s_suppkey", (F.col("s_nationkey") % 4).alias("family"), F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") * 37 % 1009) / 10090.0).alias("p"))


def holm_adjust(s, d):
    return metrics.holm(_p_values(s, d), "p", ["family"], ["s_suppkey"]).select("s_suppkey", "family", r6("p", "p"), r6("p_holm", "p_holm"))


def wilcoxon_statistic(s, d):
    a = report.aligned(src.scored(s, d), src.scored(s, d, True))
    return report.wilcoxon_statistic(a, "margin", "margin_surr", ["subject"]).select("subject", "n", *(r6(c, c) for c in ("w_plus", "w_minus", "statistic")))


def spearman_by_subject(s, d):
    a = report.aligned(src.scored(s, d), src.scored(s, d, True)).withColumn("margin", F.round("margin", 9)).withColumn("margin_surr", F.round("margin_surr", 9))
    return metrics.spearman(a, "margin", "margin_surr", ["subject"]).select("subject", "n", r6("spearman", "spearman"))


# surrogates


def pooled_moments(s, d):
    return surrogates.pooled_moments(src.sig_windows(s, d)).select(F.col("n").cast("bigint").alias("n"), r6("mean", "mean"), r6("var", "var"))


def flatline_windows(s, d):
    f = surrogates.flatline(src.sig_windows(s, d))
    return f.select("window_id", F.size("x").cast("bigint").alias("n"), r6(F.array_min("x"), "low"), r6(F.array_max("x"), "high"))


def donor_broken(s, d):
    return surrogates.donors(src.sig_windows(s, d), SEED, False)


def donor_preserved(s, d):
    return surrogates.donors(src.sig_windows(s, d), SEED, True)


def permuted_features(s, d):
    w = src.sig_windows(s, d)
    f = w.select("subject", "window_id", "y", arrays.mean(F.col("x")).alias("f_mean"), arrays.sd(F.col("x")).alias("f_sd"))
    return surrogates.permuted(f, surrogates.donors(w, SEED, False), ["f_mean", "f_sd"]).select("subject", "window_id", "y", "donor", r6("f_mean", "f_mean"), r6("f_sd", "f_sd"))


def gaussian_windows(s, d):
    return exploded(surrogates.gaussian(src.sig_windows(s, d), SEED), F.col("x"))


def iaaft_windows(s, d):
    return exploded(surrogates.iaaft(src.sig_windows(s, d), SEED), F.col("x"))


# models


def _sig_features(w):
    """Of the whole window: mean, deviation, and the means of its four quarters."""
    quarters = arrays.bin_mean(F.col("x"), 4)
    return w.select("subject", "window_id", "y", arrays.mean(F.col("x")).alias("m"), arrays.sd(F.col("x")).alias("s"), *(F.get(quarters, F.lit(i)).alias(f"x{i}") for i in range(4)))


SIG_FEATURES = ["m", "s", *(f"x{i}" for i in range(4))]


def loso_logreg(s, d):
    return models.loso_logreg(_sig_features(src.sig_windows(s, d)), SIG_FEATURES)


def permutation_floor(s, d):
    return models.permutation_scores(_sig_features(src.sig_windows(s, d)), SIG_FEATURES, REPS, SEED).select("model", "rep", r6("macro_f1", "macro_f1"))


def classical_floor(s, d):
    return models.floor_report(_sig_features(src.sig_windows(s, d)), SIG_FEATURES, REPS, SEED).select("part", "model", "statistic", "subject", r6("value", "value"))


#: Rungs of the surrogate ladder, and whether they are null: the last keeps the labels' signal.
RUNGS = {"deleted": True, "flatline": True, "gaussian": True, "iaaft": True, "subject_perm_broken": True, "subject_perm_preserved": False}


def _rung(w, rung):
    """The windows w with the channel of a rung."""
    if rung == "flatline":
        return surrogates.flatline(w)
    if rung == "gaussian":
        return surrogates.gaussian(w, SEED)
    if rung == "iaaft":
        return surrogates.iaaft(w, SEED)
    return surrogates.permuted(w, surrogates.donors(w, SEED, rung == "subject_perm_preserved"), ["x"])


def surrogate_ledger(s, d):
    """Per rung macro F1 of the regression, of each subject and of all rows (null subject); no model is fitted without a signal."""
    w = src.sig_windows(s, d)
    out = None
    for rung, null in RUNGS.items():
        if rung == "deleted":
            p = w.rollup("subject").agg(F.count("*").alias("n")).withColumn("macro_f1", F.lit(None).cast("double"))
        else:
            p = metrics.macro_f1_rollup(models.loso_logreg(_sig_features(_rung(w, rung)), SIG_FEATURES).withColumn("failure", F.lit(False)))
        p = p.select(F.lit(rung).alias("rung"), F.lit(null).alias("is_null"), "subject", F.col("n").alias("n_rows"), "macro_f1")
        out = p if out is None else out.unionByName(p)
    return out


def tree_depth3_loso(s, d):
    return models.loso_tree(_sig_features(src.sig_windows(s, d)), SIG_FEATURES)


def _votes(s, d, negate):
    return models.adjective_votes(matrix(s, d), VOTE_FEATURES, negate)


def adjective_vote_i(s, d):
    return _votes(s, d, False).select("window_id", "y", "vote", "yhat")


def adjective_vote_iii(s, d):
    return _votes(s, d, True).select("window_id", "y", "vote", "yhat")


# scoring


def argmax_label(s, d):
    r = src.scored(s, d).withColumn("logprob_b", F.when(F.col("window_id").cast("bigint") % 11 != 0, F.col("logprob_b")))
    return r.select("window_id", F.coalesce(metrics.argmax_label(F.col("logprob_a"), F.col("logprob_b")), F.lit(-1)).alias("yhat"))


def condition_summary(s, d):
    c = scoring.summarise(src.scored(s, d), ["subject"])
    return c.select("subject", "n_scored", "n_failures", r6("macro_f1", "macro_f1"))


def prompt_scoring(s, d):
    w = src.sig_windows(s, d).withColumn("prompt", text.prompt(text.series_text(arrays.bin_mean(F.col("x"), 8), F.lit("ecg"), F.lit(4.0), F.lit("bin_mean")), "minimal"))
    return scoring.score_prompts(w, scoring.constant_scorer()).select("window_id", "prompt", "yhat", "failure")


# free text


def first_number_mae(s, d):
    a = _anchor(s, d).withColumn("pred", text.first_number(F.col("body")))
    return scoring.text_scores(a.withColumn("all", F.lit("all")), "pred", "label", ["label"]).select("label", "n", "parsed", "failures", r6("mae", "mae"))


def label_distribution(s, d):
    """Labels that texts state as 'is N', those of texts without one as null, and the error of always saying 3."""
    a = _anchor(s, d)
    return a.groupBy(text.label_of(F.col("body"), strict=False).alias("label")).agg(F.count("*").alias("n")).withColumn("constant_mae", F.abs(F.lit(3.0) - F.col("label")))


def bracket_list_mean(s, d):
    t = src.samples(s, d).groupBy("recording").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda r: F.round(r["v"], 2).cast("string")).alias("v"))
    t = t.select("recording", F.concat(F.lit("[Value]: ["), F.array_join("v", ", "), F.lit("]")).alias("body"))
    v = text.bracket_list(F.col("body"), "Value")
    return t.select("recording", F.size(v).cast("bigint").alias("n"), F.round(arrays.mean(v), 4).alias("mean"))


def seed_aggregate(s, d):
    a = _anchor(s, d).withColumn("pred", text.first_number(F.col("body"))).withColumn("seed", F.col("doc_id") % 3)
    per = scoring.text_scores(a, "pred", "label", ["seed"])
    return per.agg(F.count("*").alias("seeds"), r6(F.avg("mae"), "mean"), r6(F.coalesce(F.stddev_samp("mae"), F.lit(0.0)), "sd"))


def verbalize_logic(s, d):
    m = matrix(s, d)
    j = m.join(folds.train_medians(m, ["f_mean", "f_sd"]).withColumnRenamed("test_subject", "subject"), "subject")
    state = lambda c: F.when(F.col(c).isNull(), "unavailable").when(F.col(c) > F.col(f"median_{c}"), "elevated").otherwise("reduced").alias(f"state_{c}")
    return j.select("window_id", state("f_mean"), state("f_sd"))


def verbalized_rows(s, d):
    m = matrix(s, d)
    j = m.join(folds.train_medians(m, FEATURES).withColumnRenamed("test_subject", "subject"), "subject")
    return j.select("window_id", F.concat_ws(" ", *(text.verbalized(n, F.col(c), F.col(f"median_{c}")) for c, n in VOTE_FEATURES.items())).alias("text"))


def prompt_render(s, d):
    w = src.sig_windows(s, d)
    body = F.concat(F.lit("subject "), F.col("subject"), F.lit(" part "), F.col("seg_name"))
    shown = F.array(F.struct(F.lit("first").alias("body"), F.lit("A").alias("token")), F.struct(F.lit("second").alias("body"), F.lit("B").alias("token")))
    return w.select("window_id", text.prompt(body, "instruction", shown).alias("prompt"))


def zero_shot_prompts(s, d):
    a = _anchor(s, d)
    return a.select("doc_id", anchor_text.zero_shot(F.lit("Read the text.\n"), F.col("body"), anchor_text.example_number(SEED, F.col("doc_id"))).cast("binary").alias("prompt")).select("doc_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def plot_digests(s, d):
    return src.sig_windows(s, d).select("window_id", F.sha2(png.plot("x"), 256).alias("png_sha256"))


def content_hash(s, d):
    """Of all rows and columns of documents, whatever their order; null texts are passed over."""
    t = src.table(s, d, "documents")
    return t.agg(F.count("*").alias("n"), F.sum(rng.bits(F.concat_ws("|", *(F.col(c).cast("string") for c in ("doc_id", "text", "lang", "source", "n_chars"))))).alias("hash"))


_SKIP = {"r6", "exploded", "matrix"}
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in _SKIP}
