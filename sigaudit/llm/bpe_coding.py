"""Operator 10: BPE encoding and decoding of a text column, by per-prefix dynamic programming (see bpe.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import bound_batches

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """Per row doc_id, n_tokens, ids (array of int, if wanted), decoded, ids_sha256, decoded_sha256 of the whole text.

    A null or empty text has no ids and decodes to the empty text. Equal texts and repeated rows give equal results, one row
    each; an empty table gives no rows; other columns, whatever their names, are not read. Without ids, decoded is left out too.
    """
    bound_batches(docs.sparkSession)
    kind = "doc_id bigint, n_tokens bigint, " + "ids array<int>, decoded string, " * ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = batch.column(1)
            cols: list[list] = [[], [], [], [], []]
            for text in texts:
                raw = bpe.encode_bytes(text.as_py())
                back = bpe.decode_bytes(raw)
                cols[0].append(len(raw) // 4)
                if ids:
                    cols[1].append(memoryview(raw).cast("I").tolist())
                    cols[2].append(back.decode())
                cols[3].append(hashlib.sha256(raw).hexdigest())
                cols[4].append(hashlib.sha256(back).hexdigest())
            names, data = ["doc_id", "n_tokens"], [batch.column(0), pa.array(cols[0], pa.int64())]
            if ids:
                names, data = [*names, "ids", "decoded"], [*data, pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*data, pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], [*names, "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, kind)


def op10_bpe_coding(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)
