"""Operator 9: text statistics, base rules, and robust multivariate outliers. DataFrame functions only.

Per language and source the minimum-covariance-determinant estimate of location and scatter of transformed statistics is found by
concentration steps: the rows nearest by Mahalanobis distance under the current estimate give the next one. TRIED steps are made from
each of several starts, and more, STEPS in all at most, from the start of least determinant while its determinant moves; of the corpora
seen, 20 steps gave the same verdicts as six. Estimates of a source are drawn towards that of its
language as if PRIOR rows spoke for it, whatever the size of either. A row far from the estimate of its group is rejected. Moments and
distance histograms are mergeable sums, so no group is ever gathered.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save, table

SPACE = r"[\x20\x09-\x0D]+"
#: Share of a group that the estimate rests on; concentration steps from all starts, steps at most, and the move of the log determinant
#: that ends them; rows that the language's estimate counts for in a source's.
CORE, TRIED, STEPS, STILL, PRIOR = 0.5, 2, 6, 1e-2, 20
#: Starts of a group: all its rows, and samples of about so many rows drawn by hash.
STARTS, SAMPLE = 6, 10
#: Share of normal rows within the cut. Clean texts are not normal (labelled good ones have up to a third of their lines twice), so it
#: is nearer to 1 than usual.
WITHIN = 1 - 1e-6
#: Scatter that every statistic has at least (standard deviation): constant statistics would reject any deviation.
FLOOR = {"x0": 0.35, "x1": 0.05, "x2": 0.08, "x3": 0.08}
DIMENSIONS = tuple(FLOOR)


def chi_square(x: float, dof: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi_square_quantile(share: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dof) < share else (low, mid)
    return high


#: The covariance of the CORE nearest of normal rows is that of all rows divided by this.
CONSISTENCY = CORE / chi_square(chi_square_quantile(CORE, len(DIMENSIONS)), len(DIMENSIONS) + 2)
#: Rejected beyond this Mahalanobis distance (5.78).
FAR = math.sqrt(chi_square_quantile(WITHIN, len(DIMENSIONS)))
#: Up to so many groups, their counted table of estimates (about 200 bytes a start) is broadcast to the rows.
FEW = 2000
#: Places in which the rows of one group meet its estimate where there are more groups: a group may hold a third of all rows.
SALTS = 16
#: Bins a unit of log distance in the histograms that place the core's border.
BINS = 64


def bind(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows sorted by hash show their repeats side by side; the positions of
    repeated windows, sorted, cover at most three words each."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        alike = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: alike(x, k - 1) | alike(x, k + 1)), lambda x: x["i"]))

    covered = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(words) < 4, 0).otherwise(bind(F.sort_array(windows), lambda s: bind(repeated(s), covered)))


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x, F.length(x)))
    counted = bind(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"), repeat_words(w).cast("bigint").alias("n_repeat_words")))
    dup = bind(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    symbols = (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("bigint")
    out = docs.select("doc_id", "lang", "source", counted.alias("w"), dup.alias("l"), symbols.alias("n_symbols"))
    out = out.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        (F.col("word_chars") / n).alias("x0"),
        F.sqrt(F.col("n_symbols") / n).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x3"),
    ]


PAIRS = list(combinations_with_replacement(DIMENSIONS, 2))


def _moments(rows: DataFrame, keys: list[str], few: bool, factor: float = 1.0, prior: DataFrame | None = None) -> DataFrame:
    """Mean, covariance (factor times that of the rows), Cholesky factor of the scatter (covariance and FLOOR) and log determinant of each
    group's rows. prior: means and covariances a wide group (its rows name it), which count for PRIOR rows of each."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(d).alias(f"m_{d}") for d in DIMENSIONS), *((factor * F.covar_pop(a, b)).alias(f"c_{a}{b}") for a, b in PAIRS))
    if prior is not None:
        names = [*(f"m_{d}" for d in DIMENSIONS), *(f"c_{a}{b}" for a, b in PAIRS)]
        prior = prior.select(F.col("group").alias("wide"), *(F.col(c).alias(f"p_{c}") for c in names))
        both = sums.join(F.broadcast(prior) if few else prior, "wide")
        sums = both.select(*keys, *(((F.col("n") * F.col(c) + PRIOR * F.col(f"p_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in names))
    scatter = {(a, b): F.col(f"c_{a}{b}") + (FLOOR[a] ** 2 if a == b else 0.0) for a, b in PAIRS}
    # the Cholesky factor column by column, so that no expression is repeated
    out = sums
    done: dict[tuple[int, int], Column] = {}
    for i, a in enumerate(DIMENSIONS):
        for j in range(i + 1):
            rest = scatter[DIMENSIONS[j], a]
            for k in range(j):
                rest = rest - done[i, k] * done[j, k]
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / done[j, j])
            done[i, j] = F.col(f"l{i}{j}")
    det = sum((2 * F.log(f"l{i}{i}") for i in range(len(DIMENSIONS))), F.lit(0.0))
    return out.select(*keys, det.alias("det"), *(f"m_{d}" for d in DIMENSIONS), *(f"c_{a}{b}" for a, b in PAIRS), *(f"l{i}{j}" for i in range(len(DIMENSIONS)) for j in range(i + 1)))


def _distance(rows: DataFrame) -> DataFrame:
    """rows (with their group's moments) with d, the Mahalanobis distance, by forward substitution."""
    out = rows
    for i, a in enumerate(DIMENSIONS):
        rest = F.col(a) - F.col(f"m_{a}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d", F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(DIMENSIONS))), F.lit(0.0))))


def _meet(rows: DataFrame, groups: DataFrame, few: bool, keys: tuple[str, ...] = ("group",), how: str = "inner") -> DataFrame:
    """rows with what groups says of their group: by broadcast of few groups, else with each group once for each salt."""
    if few:
        return rows.join(F.broadcast(groups), [*keys], how)
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    return rows.join(groups.withColumn("salt", salts), [*keys, "salt"], how)


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Rows of each (group, start): all rows of the group, and SAMPLE rows or so by hash for each other start."""
    sizes = rows.groupBy("group").agg(F.count("*").alias("size"))
    places = F.greatest(F.floor(F.col("size") / SAMPLE), F.lit(1))
    sized = _meet(rows, sizes, few).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    return sized.where((F.col("start") == 0) | (F.pmod(F.xxhash64("draw", "start"), places) == 0)).select("group", "wide", "start", *DIMENSIONS)


def robust_estimate(rows: DataFrame, few: bool, prior: DataFrame | None = None) -> DataFrame:
    """Per group of rows (group, wide, salt, draw, x0..) mean, covariance and Cholesky factor of its concentrated core: from each start
    TRIED steps on to the nearest CORE share of all rows of the group, and from that of least determinant until none moves. few: the
    rows have been counted to have at most FEW groups."""
    spark, keys = rows.sparkSession, ["group", "wide", "start"]
    estimate, at = save(_moments(_starts(rows, few), keys, few, 1.0, prior))
    for step in range(STEPS):
        if step == TRIED:
            least = F.row_number().over(Window.partitionBy("group").orderBy("det", "start"))
            estimate = estimate.withColumn("place", least).where("place = 1").drop("place")
        near = _distance(_meet(rows, estimate.drop("wide"), few)).withColumn("bin", F.floor(F.log1p("d") * BINS))
        bins = near.groupBy("group", "start", "bin").count()
        upto = Window.partitionBy("group", "start").orderBy("bin")
        share = bins.withColumn("upto", F.sum("count").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("count").over(Window.partitionBy("group", "start")))
        border = share.where(F.col("upto") >= CORE * F.col("all")).groupBy("group", "start").agg(F.min("bin").alias("border"))
        core = _meet(near, border, few, ("group", "start")).where("bin <= border").select(*keys, *DIMENSIONS)
        following, path = save(_moments(core, keys, few, CONSISTENCY, prior))
        still = step > TRIED and (following.join(estimate.select("group", "start", F.col("det").alias("before")), ["group", "start"]).agg(F.max(F.abs(F.col("det") - F.col("before")))).first()[0] or 0.0) < STILL
        drop(spark, at)
        estimate, at = following, path
        if still:
            break
    return estimate.drop("start", "wide", "det")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row doc_id, the statistics, base_failed, distance and kept.

    Null and empty texts have no words and fail the base rules. A null lang or source is a value of its own. A source of few rows is
    judged by its language's estimate more than by its own, and a lone row of a language by itself: it is kept. Repeated rows count
    each. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", "text", "lang", "source")
    wide = F.coalesce("lang", F.lit("\x00"))
    named = with_stats(given).withColumn("wide", wide).withColumn("group", F.concat_ws("\x1f", wide, F.coalesce("source", F.lit("\x00"))))
    stats, _ = save(named.withColumn("draw", F.xxhash64("doc_id", "n_words", "word_chars")).withColumn("salt", F.pmod("draw", F.lit(SALTS))))
    rows = stats.select("*", *_transformed())
    core = rows.where(~F.col("base_failed")).select("group", "wide", "salt", "draw", *DIMENSIONS)
    few = core.select("group").distinct().count() <= FEW
    languages = robust_estimate(core.withColumn("group", F.col("wide")), few)
    out = _distance(_meet(rows, robust_estimate(core, few, languages), few, how="left"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d"), F.lit(0.0)) <= FAR)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d").alias("distance"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
