"""Operator 5: packing of tokenised documents into sequences of a fixed length.

Pattern packing by non-negative least squares: patterns are few-document combinations of lengths that fill a sequence; repeat counts
are fitted to the histogram of lengths, rounded down, and the residual lengths are packed best-fit. All of this works on the
histogram, whose size is the sequence length, never on documents. Documents then find their place by the number of their piece
among those of its length: the tasks that cut texts number the pieces of each length as they come, the numbers of earlier tasks are
added, and a binary search among the plan's slots of that length does the rest. No window, and no sort of pieces, is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LibraryCodec, codec
from .bpe_coding import tokenizer_path
from .common import bound_batches, lean, save, table

LENGTH, END_ID = 1024, 2
#: Patterns of three lengths in the fit, at most (the most frequent lengths first; the others are residuals and are packed best-fit);
#: iterations of the fit.
TRIPLES, STEPS = 6000, 400


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32 (and ids), and its number among the pieces of its length in its part (task).
    The first piece of a long document takes what is left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, LibraryCodec)
        end = int(end_id).to_bytes(4, "little")
        seen = [0] * (length + 1)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = bpe.encode_bytes(text.as_py()) + end
                n, at, piece = len(raw) // 4, 0, 0
                while at < n:
                    size = length if piece or n % length == 0 else n % length
                    own = raw[4 * at : 4 * (at + size)]
                    for c, v in zip(cols, (doc_id, piece, at, size, zlib.crc32(own), part, seen[size], memoryview(own).cast("I").tolist() if ids else None), strict=True):
                        c.append(v)
                    seen[size] += 1
                    at, piece = at + size, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number", "ids"][: 7 + ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, kinds, strict=True))[: 7 + ids]], names)

    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.spark_partition_id()).mapInArrow(lean(run, keeps=True), kind)


def patterns(count: np.ndarray, length: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence exactly: all pairs, and triples of the most frequent lengths."""
    have = np.flatnonzero(count)
    have = have[(have > 0) & (have < length)]
    there = np.zeros(length + 1, bool)
    there[have] = True
    pairs = [(a, length - a, 0) for a in have if a >= length - a and there[length - a]]
    wanted, triples = have[np.argsort(-count[have], kind="stable")], []
    for i in range(len(wanted)):
        for j in range(i + 1):
            c = length - wanted[i] - wanted[j]
            if 0 < c < length and there[c] and c <= min(wanted[i], wanted[j]):
                triples.append((wanted[i], wanted[j], c))
        if len(triples) >= TRIPLES:
            break
    return np.array(pairs + triples[:TRIPLES], np.int64).reshape(-1, 3)


def fit(found: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts x that bring the lengths used closest to the histogram in squares: accelerated projected gradient."""
    if not len(found):
        return np.zeros(0)
    scale = float(count.max())
    goal = count / scale
    columns = [c for c in range(3)]

    def used(x):
        return sum(np.bincount(found[:, c], x, len(count)) for c in columns) * np.r_[0, np.ones(len(count) - 1)]

    def back(r):
        r = np.r_[0, r[1:]]
        return sum(r[found[:, c]] for c in columns)

    power = np.ones(len(found))
    for _ in range(20):
        power = back(used(power))
        size = np.linalg.norm(power)
        power /= size
    x = look = np.zeros(len(found))
    t = 1.0
    for _ in range(STEPS):
        following = np.maximum(0, look - back(used(look) - goal) / size)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = following + (t - 1) / t2 * (following - x)
        x, t = following, t2
    return x * scale


def plan(count: np.ndarray, length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for a histogram of lengths (count[l] pieces of l tokens, 1 <= l <= length): (lengths, repeats)."""
    count = count.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if count[length]:
        out.append(((length,), int(count[length])))
        count[length] = 0
    found = patterns(count, length)
    x = np.floor(fit(found, count) + 1e-9).astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        lengths = [int(v) for v in found[k] if v]
        need = {v: lengths.count(v) for v in lengths}
        times = min([int(x[k]), *(int(count[v]) // m for v, m in need.items())])
        if times > 0:
            out.append((tuple(lengths), times))
            for v, m in need.items():
                count[v] -= m * times
    # residuals, longest first, each into the fullest open pattern that has room; bins of the same content go together
    open_bins: dict[int, list[list]] = {}
    for v in range(length, 0, -1):
        left = int(count[v])
        room = v
        while left and room < length:
            group = open_bins.get(room)
            if not group:
                room += 1
                continue
            lengths, n = group.pop()
            times = min(n, left)
            if n > times:
                group.append([lengths, n - times])
            open_bins.setdefault(room - v, []).append([(*lengths, v), times])
            left -= times
        if left:
            per = length // v
            full, rest = divmod(left, per)
            for k, times in ((per, full), (rest, 1)):
                if k and times:
                    open_bins.setdefault(length - k * v, []).append([(v,) * k, times])
    out += [(tuple(lengths), n) for group in open_bins.values() for lengths, n in group if n]
    return out


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """cut (doc_id, length, part, number and more columns, numbered from 0 in each part and length) with sequence_id and offset:
    sequences of at most length tokens, as few as the plan finds, filled from 0 without gaps."""
    groups = cut.groupBy("length", "part").agg((F.max("number") + 1).alias("count"))
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = np.zeros(length + 1, np.int64)
    for row in groups.groupBy("length").agg(F.sum("count").alias("n")).collect():  # one row a length
        count[row["length"]] = row["n"]
    # every slot of every pattern takes the next pieces of its length; slots are bounded by patterns, whatever the input
    taken, first, slots = np.zeros(length + 1, np.int64), 0, []
    for lengths, times in plan(count, length):
        at = 0
        for v in lengths:
            slots.append((v, int(taken[v]), first, at))
            taken[v] += times
            at += v
        first += times
    size, low, sequence, offset = np.array(slots or [(0, 0, 0, 0)], np.int64).T
    order = np.lexsort((low, size))
    size, low, sequence, offset = size[order], low[order], sequence[order], offset[order]
    from_, to = np.searchsorted(size, np.arange(length + 1), "left"), np.searchsorted(size, np.arange(length + 1), "right")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        n, number = lengths.to_numpy(np.int64), numbers.to_numpy(np.int64)
        slot = np.zeros(len(n), np.int64)
        for v in np.unique(n):
            own = n == v
            slot[own] = from_[v] + np.searchsorted(low[from_[v] : to[v]], number[own], "right") - 1
        return pd.DataFrame({"sequence_id": sequence[slot] + number - low[slot], "offset": offset[slot]})

    numbered = cut.join(groups.select("length", "part", earlier.alias("earlier")), ["length", "part"])
    placed = numbered.withColumn("place", place("length", F.col("number") + F.col("earlier")))
    columns = [c for c in cut.columns if c not in ("part", "number")]
    return placed.select(*columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """Tokenise docs (doc_id, text) and pack them: per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null and empty texts are one piece, the end id alone. Repeated rows are packed once each. An empty table gives no rows. Other
    columns, whatever their names, are not read.
    """
    bound_batches(docs.sparkSession)
    cut, _ = save(pieces(docs, path, length, ids=ids))
    return pack(cut, length)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
