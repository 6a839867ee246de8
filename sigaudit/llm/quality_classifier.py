"""Operator 1: quality classifier on supervised subword embeddings.

Words, word pairs and character n-grams (of 3 and of 5 code points) are hashed to learned vectors; a document is the average of its
vectors, and a softmax layer on it gives the label. Vectors and layer are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled documents, whose features Spark computes. As the layer is linear, each vector is projected through it once before scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bound_batches, held_out, lean, slices, table, utf8
from .words import hashes, mix, spans

#: Labelled documents that training uses at most (those of the smallest id hashes), vectors, their length, code points of an n-gram.
SAMPLE, BUCKETS, DIMENSIONS, GRAMS = 3000, 1 << 14, 8, (3, 5)
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 12, 500, 32, 200.0, 7
#: Predicted 1 from this score on.
CUT = 0.3
#: Bytes of text whose features a task holds at a time.
SCORED = 1 << 18
#: The slot of a pair of equal words.
SAME = 0


def code_points(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts, white space as one kind, and where each text's begin (and past the last)."""
    points = np.frombuffer(b.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begun = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return np.where((points == 32) | ((points >= 9) & (points <= 13)), np.uint64(32), points), begun[at]


def features(raw: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of the texts: per kind their slots in text order, and for each text where its first is (and past the last)."""
    b, at = raw[at[0] : at[-1]], at - at[0]
    slot = lambda h: (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    start, end = spans(b, at)
    h = hashes(b, start, end)
    first = np.searchsorted(start, at)
    out = [(slot(h), np.stack([first[:-1], first[1:]]))]
    if len(h) > 1:
        pair = slot(mix(h[:-1] * np.uint64(3) + h[1:]))
        pair[h[:-1] == h[1:]] = SAME
        # a text without words at the end begins beyond the last pair
        from_ = np.minimum(first[:-1], len(pair))
        out.append((pair, np.stack([from_, np.clip(first[1:] - 1, from_, len(pair))])))
    points, first = code_points(b, at)
    for k in GRAMS:
        if len(points) >= k:
            code = np.zeros(len(points) - k + 1, np.uint64)
            for j in range(k):
                code = code * np.uint64(0x9E3779B97F4A7C15) + points[j : j + len(code)]
            from_ = np.minimum(first[:-1], len(code))
            out.append((slot(mix(code + np.uint64(k << 56))), np.stack([from_, np.clip(first[1:] - k + 1, from_, len(code))])))
    return out


@dataclass
class Model:
    """vectors (slots x dimensions), layer (dimensions x 2), bias (2)."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def weights(self) -> tuple[np.ndarray, float]:
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """rows: per document its slots and their shares of all its features (which sum to 1)."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    share = np.bincount(labels, minlength=2) + 1.0
    bias = np.log(share / share.sum()).astype(np.float32)
    batches = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            x = np.zeros((len(part), BUCKETS), np.float32)
            for r, i in enumerate(part):
                x[r, rows[i][0]] = rows[i][1]
            hidden = x @ vectors
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p /= len(part)
            rate = RATE * (1 - step / steps)
            back = p @ layer.T
            layer -= 0.02 * rate * (hidden.T @ p)
            bias -= 0.02 * rate * p.sum(axis=0)
            vectors -= rate * (x.T @ back)
            step += 1
    return Model(vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Train on at most sample labelled rows of docs that are not held out; None if there is no such row."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.min(column).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(2))
            for lo, hi in slices(at, SCORED):
                kinds = features(raw, at[lo : hi + 1])
                packed = []
                for i in range(hi - lo):
                    x = np.concatenate([s[a[0, i] : a[1, i]] for s, a in kinds])
                    slots, counts = np.unique(x, return_counts=True)
                    packed.append(slots.astype("<u2").tobytes() + (counts / max(len(x), 1)).astype("<f4").tobytes())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["doc_id", "label", "packed"])

    # the chosen ids are bounded by sample, so they may be broadcast
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("bigint"), F.col("label").cast("int"), "text")
    found = rows.mapInArrow(lean(run), "doc_id bigint, label int, packed binary")
    # of rows with one id the one of fewest features; six bytes a feature, a partition at a time
    kept: dict[int, tuple[int, bytes]] = {}
    for r in found.toLocalIterator():
        if r["doc_id"] not in kept or (len(r["packed"]), r["packed"]) < (len(kept[r["doc_id"]][1]), kept[r["doc_id"]][1]):
            kept[r["doc_id"]] = (r["label"], bytes(r["packed"]))
    if not kept:
        return None
    order = sorted(kept)
    unpacked = [(np.frombuffer(p, "<u2", len(p) // 6), np.frombuffer(p, "<f4", len(p) // 6, len(p) // 6 * 2)) for p in (kept[i][1] for i in order)]
    return train(unpacked, np.array([kept[i][0] for i in order], np.int64))



def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with a column score of the whole text (0 to 1); a null or empty text has the score of no features."""
    bound_batches(docs.sparkSession)
    weights, bias = model.weights() if model else (np.zeros(BUCKETS), 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(np.float64)
        for batch in batches:
            raw, at = utf8(batch.column(place))
            out = []
            for lo, hi in slices(at, SCORED):
                total, n = np.zeros(hi - lo), np.zeros(hi - lo)
                for s, (a, z) in features(raw, at[lo : hi + 1]):
                    c = np.concatenate([[0.0], np.cumsum(w[s])])
                    total += c[z] - c[a]
                    n += z - a
                logit = np.clip(total / np.maximum(n, 1) + bias, -50, 50)
                out.append(np.round(1 / (1 + np.exp(-logit)), 6))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField("quality_score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality", cut: float = CUT) -> DataFrame:
    """Per row doc_id, held_out, score (higher: label 1 likelier) and predicted (1 if score >= cut).

    Trained on rows that are not held out; labels other than 0 and 1 and rows of null doc_id teach nothing, a document labelled twice
    counts once with the smaller label, and without labels every score is 0.5. Null and empty texts get the score of no features.
    Repeated rows are scored alike. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    model = fit(docs, labels, column)
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= cut).cast("int").alias("predicted"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
