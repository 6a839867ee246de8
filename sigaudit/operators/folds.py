"""Leave-one-subject-out folds and statistics that never see the held-out subject; splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import bits
from .ranks import left_out_medians, left_out_shares


def loso(rows: DataFrame, key: str = "subject") -> DataFrame:
    """(test_subject, train_subject) of all pairs of different subjects: subjects, not rows, are paired."""
    s = rows.select(F.col(key).alias("train_subject")).distinct()
    return s.select(F.col("train_subject").alias("test_subject")).join(s, F.col("test_subject") != F.col("train_subject"))


def train_medians(rows: DataFrame, features: list[str], key: str = "subject") -> DataFrame:
    """Per held-out subject the exact medians of the others' features; missing values are passed over."""
    found = left_out_medians(rows, features, key).groupBy("key").agg(*(F.max(F.when(F.col("f") == c, F.col("median"))).alias(f"median_{c}") for c in features))
    subjects = rows.select(F.col(key).alias("key")).distinct()
    return subjects.join(found, "key", "left").withColumnRenamed("key", "test_subject")


def train_percentile(rows: DataFrame, feature: str, key: str = "subject", decimals: int = 9) -> DataFrame:
    """Share, in percent, of the other subjects' values that are at most a row's; values that agree in so many decimals are equal."""
    some = rows.where(F.col(feature).isNotNull()).withColumn("v", F.round(feature, decimals))
    shares = left_out_shares(some, ["v"], key).select(F.col("key").alias(key), "v", (100.0 * F.col("share")).alias("percentile"))
    return some.join(shares, [key, "v"]).drop("v")


def majority(rows: DataFrame, key: str = "subject", label: str = "y") -> DataFrame:
    """Per held-out subject the most frequent label of the others; a tie goes to the smallest label."""
    own = rows.groupBy(key, label).count()
    every = own.groupBy(label).agg(F.sum("count").alias("all"))
    subjects = own.select(key).distinct()
    left = subjects.crossJoin(F.broadcast(every)).join(own, [key, label], "left").withColumn("n", F.col("all") - F.coalesce("count", F.lit(0)))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), label))
    return left.withColumn("r", best).where("r = 1").select(F.col(key).alias("test_subject"), F.col(label).alias("majority"), F.col("n").alias("n_train"))


def dev_split(rows: DataFrame, n_dev: int, seed: int, key: str = "subject") -> DataFrame:
    """(subject, role): n_dev subjects of the smallest draws are dev, the others eval."""
    s = rows.select(key).distinct()
    r = F.row_number().over(Window.orderBy(bits(seed, F.col(key)), key))
    return s.withColumn("role", F.when(r <= n_dev, "dev").otherwise("eval"))


def exemplars(rows: DataFrame, n: int, seed: int, label: str = "y", row: str = "window_id", groups: list[str] | None = None) -> DataFrame:
    """n rows (of each group), n / 2 of each class by the smallest draws, class 0 first; where a class has fewer, its rows are drawn again
    from the first on. pick numbers a class's rows from 1. The limit reaches the map side, so classes are not gathered."""
    keys = [*(groups or []), label]
    half = n // 2
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(bits(seed, F.col(row)), row))
    first = rows.withColumn("r", r).where(F.col("r") <= half)
    have = F.count("*").over(Window.partitionBy(*keys))
    again = F.explode(F.sequence(F.col("r"), F.lit(half), F.col("have")))
    return first.withColumn("have", have.cast("int")).withColumn("pick", again).drop("r", "have")


def complement(pool: DataFrame, held: DataFrame, body: str) -> DataFrame:
    """Rows of pool whose body does not occur in held."""
    return pool.join(held.select(body).distinct(), body, "left_anti")


def leaks(pool: DataFrame, held: DataFrame, body: str) -> DataFrame:
    """Rows of pool whose body occurs in held: must be none after complement."""
    return pool.join(held.select(body).distinct(), body, "left_semi")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of todo not done yet; gap tells if what is done is not the first keys without a break."""
    state = done.agg(F.count_distinct(key).alias("n"), F.max(key).alias("last"), F.min(key).alias("first"))
    gap: Column = F.coalesce((F.col("last") - F.col("first") + 1 != F.col("n")), F.lit(False))
    return todo.join(done.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(state.select(gap.alias("gap"))))
