"""Locked tables: content-addressed entries that are written once and read back only as they were written.

An entry is a folder root/kind/<hash of its key> with the table and a note of its key and digest. The digest is of the rows in any order,
so part files, partitioning and column order don't matter; a row more, less or changed does.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import publish

PARTS = 4


class LockError(ValueError):
    """A lock is missing, double, or not as it was written."""


def row_text(df: DataFrame) -> Column:
    """A row as text: its columns by name, each `-` if null, else its length, a colon and itself; nested ones as JSON."""
    simple = lambda c: c if df.schema[c].dataType.typeName() not in ("array", "map", "struct", "variant") else None
    text = lambda c: F.col(f"`{c}`").cast("string") if simple(c) else F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"})
    field = lambda c: F.when(F.col(f"`{c}`").isNull(), F.lit("-")).otherwise(F.concat(F.char_length(text(c)).cast("string"), F.lit(":"), text(c)))
    return F.concat(*(field(c) for c in sorted(df.columns)))


def row_sums(df: DataFrame) -> DataFrame:
    """One row: n, and s0 to s3, the sums of four quarters of all rows' SHA-256: the same for the same rows in any order."""
    h = F.sha2(row_text(df).cast("binary"), 256)
    quarter = lambda i: F.conv(F.substring("_h", 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(h.alias("_h")).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(quarter(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(PARTS)))


def digest(df: DataFrame) -> str:
    """SHA-256 of a table: its column names and types, and its rows in any order."""
    kinds = sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return hashlib.sha256(json.dumps([kinds, *(str(v) for v in row_sums(df).head())]).encode()).hexdigest()


def _entry(root: str, kind: str, key: dict) -> str:
    text = json.dumps(key, sort_keys=True, separators=(",", ":"))
    return f"{root.rstrip('/')}/{kind}/{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def lock(df: DataFrame, root: str, kind: str, key: dict) -> dict:
    """Lock df under a key; returns the note. Raises AlreadyPublished if the key has a lock. The note is published last: an entry without
    one is no lock, and is replaced by the next writer's only after it is deleted by hand."""
    spark, place = df.sparkSession, _entry(root, kind, key)
    if publish.exists(spark, f"{place}/note"):
        raise publish.AlreadyPublished(place)
    publish.publish(df, f"{place}/data")
    kept = spark.read.parquet(f"{place}/data")
    note = {"kind": kind, "key": key, "sha256": digest(kept), "n_rows": kept.count(), "columns": sorted(kept.columns), "created_utc": datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")}
    publish.publish_text(spark, json.dumps(note, sort_keys=True), f"{place}/note", "lock.json")
    return note


def note(spark: SparkSession, root: str, kind: str, key: dict) -> dict:
    place = _entry(root, kind, key)
    if not publish.exists(spark, f"{place}/note"):
        raise LockError(f"no {kind} is locked for {json.dumps(key, sort_keys=True)}")
    return json.loads(publish.read_text(spark, f"{place}/note", "lock.json"))


def locked(spark: SparkSession, root: str, kind: str, key: dict) -> DataFrame:
    """The table that was locked under a key. Raises if there is none, or if it is not what was locked."""
    given = note(spark, root, kind, key)
    df = spark.read.parquet(f"{_entry(root, kind, key)}/data")
    if given["key"] != key or digest(df) != given["sha256"]:
        raise LockError(f"the {kind} of {json.dumps(key, sort_keys=True)} is not what was locked")
    return df


def assert_same(df: DataFrame, spark_root: str, kind: str, key: dict) -> None:
    """Raise unless df has the very rows that are locked under the key."""
    if digest(df) != note(df.sparkSession, spark_root, kind, key)["sha256"]:
        raise LockError(f"rows differ from the {kind} locked for {json.dumps(key, sort_keys=True)}")


def registry(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """kind, key (JSON), sha256, n_rows, created_utc of all locks of a kind."""
    raw = spark.read.text(f"{root.rstrip('/')}/{kind}/*/note/lock.json", wholetext=True)
    get = lambda path: F.get_json_object("value", f"$.{path}")
    return raw.select(get("kind").alias("kind"), get("key").alias("key"), get("sha256").alias("sha256"), get("n_rows").cast("bigint").alias("n_rows"), get("created_utc").alias("created_utc"))


def lookup(wanted: DataFrame, entries: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """wanted with the columns of the one entry of its keys. The job fails at the first row whose keys have no entry, or more than one;
    null keys have none. few: the entries go to the rows, which are not dealt by key."""
    values = [c for c in entries.columns if c not in keys]
    one = entries.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by(F.struct(*values), F.lit(0)).alias("_v"))
    named = F.to_json(F.struct(*(F.col(k) for k in keys)), {"ignoreNullFields": "false"})
    joined = wanted.join(F.broadcast(one) if few else one, keys, "left")
    bad = F.when(F.col("_n").isNull(), F.concat(F.lit("no entry for "), named)).when(F.col("_n") > 1, F.concat(F.col("_n").cast("string"), F.lit(" entries for "), named))
    guard = F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True))
    return joined.where(guard).select(*wanted.columns, *(F.col(f"_v.{c}").alias(c) for c in values))


def require(entries: DataFrame, keys: list[str], rows: int | None = None, present: list[str] | None = None, never: Column | None = None) -> DataFrame:
    """entries, if they can be locked: as many as rows, one a key, no null or NaN in the columns present, none for which never holds.
    Raises and names all that is wrong, otherwise."""
    kinds = dict(entries.dtypes)
    empty = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    columns = present if present is not None else entries.columns
    facts = entries.agg(F.count("*").alias("rows"), F.count_if(never if never is not None else F.lit(False)).alias("never"), *(F.count_if(empty(c)).alias(f"empty {c}") for c in columns)).head()
    double = entries.groupBy(*keys).count().where("count > 1").limit(5).collect()
    wrong = [f"{facts['rows']} entries, not {rows}"] if rows is not None and facts["rows"] != rows else []
    wrong += [f"{facts[f'empty {c}']} entries without {c}" for c in columns if facts[f"empty {c}"]]
    wrong += [f"{facts['never']} entries that may not be"] if facts["never"] else []
    wrong += [f"{r['count']} entries for {', '.join(str(r[k]) for k in keys)}" for r in double]
    if wrong:
        raise LockError("; ".join(wrong))
    return entries


def locked_items(items: DataFrame, split: DataFrame, key: str = "item_id") -> tuple[DataFrame, dict[str, int]]:
    """The items of a locked split (key, part), and how many a part. Raises where the split names an item that is not there or twice."""
    parts = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}
    if split.groupBy(key).count().where("count > 1").limit(1).count():
        raise LockError(f"the split names a {key} twice")
    found = items.join(split, key)
    seen = {r["part"]: r["count"] for r in found.groupBy("part").count().collect()}
    if seen != parts:
        raise LockError(f"items of the split: {seen}, not {parts}")
    return found, parts


def label_logprobs(steps: Column, labels: dict[str, str]) -> Column:
    """A struct of log probabilities, one a label (name to its text), out of a decoding step's candidates (array of token, logprob).

    A token counts for a label if the two are equal once white space around them, a leading word mark and the case of A-Z are taken
    away; of several such tokens the best counts. A label that is not among the candidates, or has no finite number, is missing.
    """
    plain = lambda t: F.lower(F.trim(F.regexp_replace(t, "^[\\u2581\\u0120\\s]+|\\s+$", "")))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    one = lambda text: F.array_max(F.transform(F.filter(steps, lambda s: (plain(s["token"]) == text.strip().lower()) & finite(s["logprob"])), lambda s: s["logprob"]))
    return F.struct(*(one(text).alias(name) for name, text in labels.items()))


def scored_steps(rows: DataFrame, steps: str, labels: dict[str, str]) -> DataFrame:
    """rows with logprob_<label> of each label, failure (a label is missing) and, without one, yhat: the number of the best label (of
    equal ones the first)."""
    got = rows.withColumn("_p", label_logprobs(F.col(steps), labels))
    names = list(labels)
    failure = F.greatest(*(F.col(f"_p.{n}").isNull().cast("int") for n in names), F.lit(0)) == 1
    best = F.array_position(F.array(*(F.col(f"_p.{n}") for n in names)), F.greatest(*(F.col(f"_p.{n}") for n in names), F.col(f"_p.{names[0]}"))) - 1
    return got.select(*rows.columns, *(F.col(f"_p.{n}").alias(f"logprob_{n}") for n in names), failure.alias("failure"), F.when(~failure, best.cast("int")).alias("yhat"))
