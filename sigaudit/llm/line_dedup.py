"""Operator 4: corpus-wide line deduplication.

Lines are exploded with the 128-bit hash of their normalised form, documents are counted per hash, and lines whose hash occurs in
too many documents are dropped everywhere but in the document with the largest id; what stays is put together by position.
Only hashes are shuffled for counting; texts move once, to meet the list of hashes that their document loses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bound_batches, lean, table

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
SALTS = 16


def line_hash(line: str, min_chars: int) -> bytes | None:
    """The hash of a line's key (stripped of white space at both ends, A-Z as a-z), or None if the key is shorter than min_chars."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None  # bytes: only A-Z


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key): the distinct line hashes of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            keys: list[bytes] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {line_hash(x, min_chars) for x in (text.as_py() or "").split("\n")} - {None}
                ids += [doc_id] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id bigint, key binary")


def without_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs, whose last column lost_lines has the hashes of lines to drop, with the lines left put together by position."""
    schema = StructType([*docs.schema.fields[:-1], StructField("line_counts", StructType([StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            counts: list[dict] = []
            for text, lost in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                every = (text.as_py() or "").split("\n")
                bad = set(lost.as_py() or ())
                kept = [x for x in every if line_hash(x, min_chars) not in bad] if bad else every
                texts.append("\n".join(kept))
                counts.append({"n_lines": len(every), "n_dropped": len(every) - len(kept)})
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64())]))], names=[*batch.schema.names[:-1], "line_counts"])

    return docs.mapInArrow(lean(run), schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text after dropping, and with line_counts: a struct of n_lines (before) and n_dropped.

    A key of at least min_chars code points that at least min_docs documents hold loses all its lines except those in the largest
    doc_id holding it. Null or empty text: one empty line. Rows of the same doc_id count as one document and lose the same lines.
    Rows of null doc_id are no document: they count for nothing and lose no line. An empty table gives no rows. Other columns are
    passed on.
    """
    bound_batches(docs.sparkSession)
    lines = line_keys(docs.where("doc_id is not null"), min_chars)
    common = lines.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # a line may be in a third of all documents: its rows meet its count in SALTS places
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    lost = salted.join(common, ["key", "salt"]).where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(F.collect_set("key").alias("lost_lines"))

    joined = docs.join(lost.withColumnRenamed("doc_id", "lost_by"), F.col("doc_id") == F.col("lost_by"), "left")
    return without_lines(joined.select(*docs.columns, "lost_lines"), min_chars)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "line_counts.n_lines", "line_counts.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
with lines as (
  select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
bad as (select k, max(doc_id) as keeper from lines where length(k) >= 40 group by k having count(distinct doc_id) >= 5)
select l.doc_id, count(*) as n_lines, count(*) filter (where b.k is not null and l.doc_id <> b.keeper) as n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.i) filter (where b.k is null or l.doc_id = b.keeper), '')) as kept_sha256
from lines l left join bad b on l.k = b.k group by l.doc_id
"""
