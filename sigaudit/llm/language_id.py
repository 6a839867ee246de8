"""Operator 2: language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into pieces of PIECE bytes. In each piece one network runs forwards and one backwards; from both states every byte
position gets language probabilities, and a document's are the average over its positions. Gates are hard sigmoids and candidates
softsigns, which numpy computes fast. Trained by backpropagation through time with Adam on pieces of a bounded sample of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out, slices, table, utf8

PIECE, STATES = 64, 8
#: Documents of a language that training uses, about (a hash of the id draws them); pieces of one of them, at most.
SAMPLE, PIECES = 500, 16
STEPS, BATCH, RATE, SEED = 220, 256, 0.025, 11
UNKNOWN = "und"


@dataclass
class Network:
    """Per direction: given (256 x 3 states: the byte's part of update, reset and candidate), state (states x 3 states); then out
    (2 states x languages), bias and the languages."""

    given: list[np.ndarray]
    state: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    names: list[str]

    def parameters(self) -> list[np.ndarray]:
        return [*self.given, *self.state, self.out, self.bias]


def run_direction(given: np.ndarray, state: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step: steps (T x N bytes) to (T x N x states). keep collects what backpropagation needs."""
    h = np.zeros((steps.shape[1], STATES), np.float32)
    out = np.empty((*steps.shape, STATES), np.float32)
    s2 = 2 * STATES
    for t in range(len(steps)):
        a = given.take(steps[t], axis=0)
        u = h @ state
        gates = a[:, :s2] + u[:, :s2]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:, :STATES], gates[:, STATES:]
        s = u[:, s2:] * r
        s += a[:, s2:]
        n = s / (1 + np.abs(s))
        if keep is not None:
            keep.append((h, gates, u[:, s2:], s, n))
        np.subtract(h, n, out=out[t])
        out[t] *= z
        out[t] += n
        h = out[t]
    return out


def back_direction(given: np.ndarray, state: np.ndarray, steps: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of given and state from those of the states, through time."""
    d_given, d_state = np.zeros_like(given), np.zeros_like(state)
    carry = np.zeros_like(kept[0][0])
    s2 = 2 * STATES
    for t in range(len(steps) - 1, -1, -1):
        h, gates, un, s, n = kept[t]
        z, r = gates[:, :STATES], gates[:, STATES:]
        g = grad[t] + carry
        dn = g * (1 - z)
        ds = dn / (1 + np.abs(s)) ** 2
        d = np.empty((len(g), 3 * STATES), np.float32)
        d[:, :STATES] = g * (h - n)
        d[:, STATES:s2] = ds * un
        d[:, :s2] *= 0.25 * ((gates > 0) & (gates < 1))
        d[:, s2:] = ds
        np.add.at(d_given, steps[t], d)
        d[:, s2:] = ds * r
        d_state += h.T @ d
        carry = g * z + d @ state.T
    return d_given, d_state


def position_probabilities(net: Network, pieces: np.ndarray) -> np.ndarray:
    """pieces (N x T bytes) to probabilities (T x N x languages)."""
    steps = np.ascontiguousarray(pieces.T)
    ahead = run_direction(net.given[0], net.state[0], steps)
    behind = run_direction(net.given[1], net.state[1], steps[::-1])[::-1]
    logits = ahead @ net.out[:STATES]
    logits += behind @ net.out[STATES:]
    logits += net.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def train(pieces: np.ndarray, labels: np.ndarray, names: list[str]) -> Network:
    """pieces: N x PIECE bytes, whole. Languages are drawn alike."""
    rng = np.random.default_rng(SEED)
    new = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network([new(256, 3 * STATES), new(256, 3 * STATES)], [new(STATES, 3 * STATES), new(STATES, 3 * STATES)], new(2 * STATES, len(names)), np.zeros(len(names), np.float32), names)
    share = 1 / np.bincount(labels, minlength=len(names))[labels]
    share /= share.sum()
    first = [np.zeros_like(x) for x in net.parameters()]
    second = [np.zeros_like(x) for x in net.parameters()]
    for step in range(1, STEPS + 1):
        part = rng.choice(len(pieces), BATCH, p=share)
        steps = np.ascontiguousarray(pieces[part].T)
        kept: tuple[list, list] = ([], [])
        ahead = run_direction(net.given[0], net.state[0], steps, kept[0])
        behind = run_direction(net.given[1], net.state[1], steps[::-1], kept[1])
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        logits = both @ net.out + net.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), labels[part]] -= 1
        p /= p.shape[0] * p.shape[1]
        d_both = p @ net.out.T
        grads0 = back_direction(net.given[0], net.state[0], steps, kept[0], d_both[:, :, :STATES])
        grads1 = back_direction(net.given[1], net.state[1], steps[::-1], kept[1], d_both[::-1, :, STATES:])
        grads = [grads0[0], grads1[0], grads0[1], grads1[1], np.einsum("tnh,tnl->hl", both, p, optimize=True), p.sum(axis=(0, 1))]
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for x, g, a, b in zip(net.parameters(), grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def cut_pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in pieces (padded by spaces): pieces, each one's text and its number of real bytes."""
    sizes = np.diff(at)
    count = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = at[owner] + number * PIECE
    real = np.minimum(PIECE, at[owner + 1] - start)
    place = start[:, None] + np.arange(PIECE)
    inside = np.arange(PIECE) < real[:, None]
    out = np.where(inside, raw[np.minimum(place, len(raw) - 1)], np.uint8(32)) if len(owner) else np.zeros((0, PIECE), np.uint8)
    return out, owner, real


def document_probabilities(net: Network, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text the average of its positions' language probabilities; zeros for a text without bytes."""
    pieces, owner, real = cut_pieces(raw, at)
    out = np.zeros((len(at) - 1, len(net.names)))
    for k in range(0, len(pieces), 8192):
        p = position_probabilities(net, pieces[k : k + 8192])
        some = real[k : k + 8192]
        short = np.flatnonzero(some < PIECE)
        total = p.sum(axis=0)
        for i in short:
            total[i] = p[: some[i], i].sum(axis=0)
        for c in range(len(net.names)):
            out[:, c] += np.bincount(owner[k : k + 8192], total[:, c], len(out))
    n = np.diff(at)
    return out / np.maximum(n, 1)[:, None]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on about sample documents of each known language that are not held out; None if there is none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).where(~held_out())
    count = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not count:
        return None
    names = sorted(count)
    share = F.create_map(*(F.lit(x) for k in names for x in (k, min(1.0, sample / count[k]))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(2))
            pieces, owner, real = cut_pieces(raw, at)
            ids, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i in range(len(ids)):
                own = np.flatnonzero(owner == i) if len(ids) < 64 else np.arange(np.searchsorted(owner, i), np.searchsorted(owner, i + 1))
                own = own[(real[own] == PIECE) | (len(own) == 1)]
                if len(own) > PIECES:
                    own = np.sort(np.random.default_rng(abs(ids[i] or 0)).choice(own, PIECES, replace=False))
                out += [(ids[i], langs[i], pieces[j].tobytes()) for j in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], ["doc_id", "lang", "piece"])

    rows = drawn.select(F.col("doc_id").cast("bigint"), "lang", F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang string, piece binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["doc_id", "lang", "piece"], kind="stable")
    names = sorted(set(rows["lang"]))
    pieces = np.frombuffer(b"".join(rows["piece"]), np.uint8).reshape(-1, PIECE)
    return train(pieces, rows["lang"].map(names.index).to_numpy(np.int64), names)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (the predicted language's pooled probability) of each whole text. A null text, or one without any
    letter, is `und` with score 0, and so is every text without a network."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for lo, hi in slices(at):
                p = document_probabilities(net, raw, at[lo : hi + 1]) if net else np.zeros((hi - lo, 1))
                best = p.argmax(axis=1)
                names = net.names if net else [UNKNOWN]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([names[i] for i in best], pa.string()), pa.array(np.round(p[np.arange(len(p)), best], 6), pa.float64())], ["doc_id", "letters", "best", "p"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), letters).mapInArrow(run, "doc_id bigint, letters boolean, best string, p double")
    return found.select("doc_id", F.when(F.col("letters"), F.col("best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from rows that are not held out, and predicts every row. Rows of null lang teach nothing; repeated rows are predicted
    alike; an empty table gives no rows; other columns, whatever their names, are not read."""
    docs = table(spark, sf_dir, "documents")
    bound_batches(spark)
    found = identify(docs, fit(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
