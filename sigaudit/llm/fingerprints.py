"""Operator 7: threshold-scaled document sketches. DataFrame functions only.

A sketch keeps every word-shingle hash below a fixed share of the hash range, so sketches of any two texts, however unequal in
length, are samples by the same rule: unions are sketches of unions, and shares of common hashes estimate resemblance and
containment. A text with shingles none of which is below the threshold keeps its smallest hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, table
from .quality_rules import SPACE, bind

#: Words of a shingle; the share of hashes kept is 1 in 2 to the power SCALE; bits of a kept hash.
WORDS, SCALE, BITS = 5, 2, 32


def sketch(text: Column, k: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted sketch of a text as array<bigint> of BITS-bit values; empty for a text without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    # a text of fewer than k words is one shingle: get() gives null beyond the end, which a hash passes over
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    hashed = lambda w: F.transform(starts(w), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(w, i + j) for j in range(k))), 64 - BITS))
    kept = lambda h: bind(F.filter(h, lambda x: x < (1 << (BITS - scale))), lambda low: F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).otherwise(F.array(F.array_min(h))))
    return bind(words, lambda w: F.when(F.size(w) > 0, bind(hashed(w), kept)).otherwise(F.array().cast("array<bigint>")))


def fingerprint(kept: Column) -> Column:
    """A sketch as text, eight hexadecimal digits a hash."""
    return F.array_join(F.transform(kept, lambda x: F.lpad(F.lower(F.hex(x)), -(-BITS // 4), "0")), "")


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of two texts; two texts without words are alike."""
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda x: bind(F.size(F.array_intersect(x["a"], x["b"])), lambda n: F.when((F.size(x["a"]) == 0) & (F.size(x["b"]) == 0), 1.0).otherwise(n / (F.size(x["a"]) + F.size(x["b"]) - n))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; a text without words is contained in any."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def union_sketch(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    below = lambda u: F.filter(u, lambda x: x < (1 << (BITS - scale)))
    return bind(F.array_union(a, b), lambda u: F.when(F.size(below(u)) > 0, F.sort_array(below(u))).when(F.size(u) > 0, F.array(F.array_min(u))).otherwise(u))


#: What tells documents apart and orders them: doc_id (null: after all others) and, of one doc_id, the text's hash.
KEY = ["last", "id", "h"]


def following(keys: DataFrame) -> DataFrame:
    """To distinct rows of KEY the columns next_last, next_id and next_h of the next larger one, and to the largest those of the
    smallest; other columns stay. Keys are sorted by ranges; only the first key of each range is looked at across ranges."""
    ranged, _ = save(keys.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()))
    key = F.struct(*KEY)
    inside = F.lead(key).over(Window.partitionBy("range").orderBy(*KEY))
    heads = ranged.groupBy("range").agg(F.min(key).alias("head"))
    order = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(order), F.min("head").over(Window.partitionBy())).alias("head"))
    found = ranged.withColumn("next", inside).join(heads, "range").withColumn("next", F.coalesce("next", "head"))
    return found.select("*", *(F.col(f"next.{c}").alias(f"next_{c}") for c in KEY)).drop("head", "range", "next")


def _sent(kept: Column) -> Column:
    """A sketch in four bytes a hash, for shuffles."""
    return F.transform(kept, lambda x: (x - (1 << (BITS - 1))).cast("int"))


def _received(sent: Column) -> Column:
    return F.transform(sent, lambda x: x.cast("bigint") + (1 << (BITS - 1)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, each of the whole text.

    Every row is a document. The next one is that of the next doc_id; among rows of one doc_id the order is that of a hash of the text,
    rows of null doc_id come last, and after the last document the first comes. The edited text has its last floor(n_chars / 2) code
    points replaced by as many first ones (or all) of the next document. So a row that is repeated is its own next but for its last
    copy, and so is a single document. Null and empty texts have an empty fingerprint. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    text = F.coalesce("text", F.lit(""))
    given = docs.select(F.col("doc_id").isNull().cast("int").alias("last"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    one = given.groupBy(*KEY).agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    order = following(given.groupBy(*KEY).agg(F.max(F.char_length("text")).alias("most")))
    # only the part of the next text that can be wanted travels to the document before it; the filter keeps both uses of `one` alike, so
    # that texts are shuffled by key once
    before = order.select(*(F.col(f"next_{c}").alias(c) for c in KEY), *(F.col(c).alias(f"by_{c}") for c in KEY), F.floor(F.col("most") / 2).cast("int").alias("half"))
    after = one.where("copies > 0").join(before, KEY).select(*(F.col(f"by_{c}").alias(c) for c in KEY), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"), _sent(sketch(F.col("text"))).alias("after"))
    pair = one.join(after, KEY)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    # of several copies all but the last are followed by the same text
    apart = F.struct("head", "after", F.lit(1).cast("bigint").alias("rows"))
    same = F.struct(F.substring(F.col("text"), F.lit(1), half).alias("head"), _sent(sketch(F.col("text"))).alias("after"), (F.col("copies") - 1).alias("rows"))
    cases = pair.select("last", "id", "text", F.explode(F.when(F.col("copies") > 1, F.array(apart, same)).otherwise(F.array(apart))).alias("c"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("c.head"), F.lit(1), half))
    both = cases.select("last", "id", "c.rows", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), "c.after")
    kept = both.select("last", "id", "rows", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other"), _received(F.col("after")).alias("after"))
    out = kept.select(
        F.when(F.col("last") == 0, F.col("id")).alias("doc_id"), "rows", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other")).alias("near_edited"), resemblance(F.col("own"), F.col("after")).alias("near_next"),
    )
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
