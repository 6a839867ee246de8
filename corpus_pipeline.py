"""A training-corpus pipeline over `documents`: quality, line dedup, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it decides takes effect. All but the last
return the columns of documents, with n_chars following the text. Stages hand over by Parquet tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigaudit.llm.bpe_coding import tokenizer_path
from sigaudit.llm.common import drop, save, table
from sigaudit.llm.jaccard_join import jaccard_components
from sigaudit.llm.line_dedup import dedup_lines
from sigaudit.llm.packing import pack_documents
from sigaudit.llm.quality_classifier import CUT, fit, score
from sigaudit.llm.secrets import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are judged by the score of no features."""
    docs = docs.select(*COLUMNS)
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).where(F.col("quality_score") >= CUT).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share. A document whose lines all go stays, with an empty text."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies, five-word shingles and similarity 0.8. Rows of one doc_id are one document and
    stay or go together; rows without a doc_id stay."""
    docs = docs.select(*COLUMNS)
    others = jaccard_components(docs, k=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by its kind in square brackets."""
    return redact(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: A learned classifier and a tokenizer have no SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; the table of a stage goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = save(stage(spark, docs, sf_dir))
        if before:
            drop(spark, before)
        before = path
    return docs
