"""Operator 12: approximate nearest neighbours by an adaptive scan over dimensions.

Vectors are dealt to the list of their nearest centroid. A query scans the lists of its nearest centroids. There, vectors are rotated at
random and scanned by blocks of columns: after each block the distance so far, scaled to all columns, is tested against the distance of
the k-th nearest found; candidates that fail are read no further. Distances of what is left are computed anew on the original vectors.

Equal vectors are one row in the index, with the smallest ids of theirs that any query can need, so that copies cost nothing. A list is
dealt in blocks of vectors, and the queries that scan it in blocks of queries, so that a task sees a bounded part of any list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save, table

#: At most so many lists, fitted on so many vectors a list: what the driver holds and what is broadcast.
LISTS, TRAINED = 4096, 64
#: Share of the k nearest in a sample that the scanned lists are to hold, measured on so many queries of the sample.
AIM, TRIED = 0.96, 256
#: Vectors and queries of one block.
BLOCK, QUERIES = 8192, 1024
#: Columns of one step of the scan; rows scanned before the threshold is looked at again; width of the test (in standard deviations).
COLUMNS, ROWS, WIDTH = 16, 1024, 2.1
SEED = 20


def usable(vector: Column) -> Column:
    """True for a vector that takes part: not null, empty or zero, without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's iteration on a sample; a list that loses all its vectors takes the vector farthest from its centroid."""
    rng = np.random.default_rng(SEED)
    centre = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds):
        near, gap = nearest(sample, centre, 1)
        near, gap = near[:, 0], gap[:, 0]
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
        empty = np.flatnonzero(size == 0)
        centre[empty] = sample[np.argsort(-gap, kind="stable")[: len(empty)]]
    return centre


def nearest(rows: np.ndarray, centre: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest centroids of each row, nearest first, and their squared distances."""
    out, gap = np.empty((len(rows), k), np.int64), np.empty((len(rows), k))
    square = (centre**2).sum(1)
    for lo in range(0, len(rows), 2048):
        part = rows[lo : lo + 2048]
        d = square - 2 * part @ centre.T + (part**2).sum(1)[:, None]
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(centre) else np.tile(np.arange(k), (len(part), 1))
        own = np.take_along_axis(d, near, 1)
        order = np.argsort(own, axis=1, kind="stable")
        out[lo : lo + len(part)], gap[lo : lo + len(part)] = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    return out, gap


def lists_to_scan(sample: np.ndarray, centre: np.ndarray, k: int, aim: float = AIM) -> int:
    """How many of its nearest lists hold the share aim of a query's k nearest. Measured in the sample, where the k nearest are farther off
    and lie in more lists than in the whole table, for queries drawn from it."""
    asked = np.random.default_rng(SEED).permutation(len(sample))[:TRIED]
    home = nearest(sample, centre, 1)[0][:, 0]
    order, _ = nearest(sample[asked], centre, len(centre))
    place = np.argsort(order, axis=1)
    square, needed = (sample**2).sum(1), []
    for row, i in enumerate(asked):
        gap = square - 2 * sample @ sample[i]
        gap[i] = np.inf
        near = np.argpartition(gap, min(k, len(gap) - 1))[:k]
        needed.append(place[row, home[near[near != i]]])
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) + 1 if len(needed) else len(centre)


def adaptive_scan(query: np.ndarray, columns: list[np.ndarray], k: int) -> np.ndarray:
    """Rows that may be among the k nearest of query, by blocks of rotated columns; every row that no test has abandoned and that is
    not beyond the k-th nearest found."""
    width = sum(c.shape[1] for c in columns)
    steps = np.cumsum([c.shape[1] for c in columns])
    parts = np.split(query, steps[:-1])
    cut = (steps / width) * (1 + WIDTH / np.sqrt(steps)) ** 2
    cut = np.where(steps < width, np.minimum(cut, 1.0), 1.0)
    kept, gaps, limit = np.empty(0, np.int64), np.empty(0), np.inf
    n = len(columns[0])
    first = min(n, max(4 * k, 64))
    for lo, hi in [(0, first), *((i, min(i + ROWS, n)) for i in range(first, n, ROWS))]:
        rows, gap = np.arange(lo, hi), None
        for part, column, c in zip(parts, columns, cut, strict=True):
            d = column[rows] - part if gap is not None else column[lo:hi] - part
            own = np.einsum("ij,ij->i", d, d)
            gap = own if gap is None else gap + own
            if limit < np.inf:
                # a hair's breadth wider, as the rotation rounds
                keep = gap <= limit * c * (1 + 1e-9)
                rows, gap = rows[keep], gap[keep]
            if not len(rows):
                break
        if len(rows):
            kept, gaps = np.concatenate([kept, rows]), np.concatenate([gaps, gap])
            if len(gaps) >= k:
                limit = np.partition(gaps, k - 1)[k - 1]
                near = gaps <= limit * (1 + 1e-9)
                kept, gaps = kept[near], gaps[near]
    return kept


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _represented(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with the k + 1 smallest ids of theirs: no query's k nearest can need another. Spark limits the ids a vector before
    it shuffles them."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, aim: float = AIM, block: int = BLOCK, some_queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which is_query, a condition on vec_id, holds.

    vectors has vec_id and embedding. score is the Euclidean distance in double precision; equal ones are ranked by the smaller vec_id.
    A query's own row is no candidate, equal vectors of other ids are. Left out are rows of null vec_id, unusable vectors (see usable) and
    those not as long as most (of several such lengths the smallest); rows of one vec_id are one, with the smallest of its vectors. A
    query of fewer than k candidates gets them all; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("id").isNotNull())
    given = given.where(usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    lengths = given.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = lengths[0][0] if lengths else 1
    index, path = save(_represented(given.where(F.size("vector") == width), k))
    n = index.count()
    lists = max(1, min(LISTS, n, int(np.sqrt(n))))
    # the smallest hashes: one sample whatever the partitioning, bounded by LISTS * TRAINED
    sample = index.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(TRAINED * lists).toArrow()
    points = _matrix(sample.column("vector"), width)
    centre = centroids(points, lists) if n else np.zeros((1, width))
    scanned = lists_to_scan(points, centre, k, aim) if n else 1

    def deal(batches, many):
        for batch in batches:
            near, _ = nearest(_matrix(batch.column(batch.schema.get_field_index("vector")), width), centre, many)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

    kind = "vector array<double>, ids array<bigint>, lists array<int>"
    placed = index.select("vector", "ids").mapInArrow(lambda b: deal(b, 1), kind).select("vector", "ids", F.col("lists")[0].alias("list"))
    placed, _ = save(placed)
    drop(spark, path)
    sizes = placed.groupBy("list").count().select("list", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    # queries with one vector are searched once; ids come back at the end
    asking = given.where(F.size("vector") == width).where(is_query)
    one, _ = save(asking.groupBy("vector").agg(F.min("id").alias("query")))
    queries = one.withColumn("ids", F.array("query")).select("vector", "ids").mapInArrow(lambda b: deal(b, scanned), kind)
    queries = queries.select(F.col("ids")[0].alias("query"), "vector", F.explode("lists").alias("list"))
    queries, _ = save(queries)
    parts = queries.groupBy("list").count().select("list", F.ceil(F.col("count") / some_queries).cast("int").alias("parts"))
    shape = F.broadcast(sizes.join(parts, "list"))  # at most LISTS rows
    some = lambda of, many: F.pmod(F.xxhash64(of), many).cast("int")
    left = placed.join(shape, "list").withColumn("block", some("vector", F.col("blocks"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = queries.join(shape, "list").withColumn("part", some("query", F.col("parts"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def scan(own: pa.Table, asked: pa.Table) -> pa.Table:
        query, gap, ids = [], [], []
        if len(own) and len(asked):
            every, wanted, turn = _matrix(own.column("vector"), width), _matrix(asked.column("vector"), width), rotation(width)
            turned, names = every @ turn, own.column("ids").to_pylist()
            columns = [np.ascontiguousarray(turned[:, i : i + COLUMNS]) for i in range(0, width, COLUMNS)]
            least_id = np.array([x[0] for x in names])
            for name, vector, q in zip(asked.column("query").to_pylist(), wanted, wanted @ turn, strict=True):
                rows = adaptive_scan(q, columns, k + 1)
                d = np.sqrt(((every[rows] - vector) ** 2).sum(1))
                for i in np.lexsort((least_id[rows], d))[: k + 1]:
                    query.append(name)
                    gap.append(float(d[i]))
                    ids.append(names[rows[i]])
        return pa.table([pa.array(query, pa.int64()), pa.array(gap, pa.float64()), pa.array(ids, pa.list_(pa.int64()))], ["query", "score", "ids"])

    keys = ["list", "block", "part"]
    found = left.select(*keys, "vector", "ids").groupBy(*keys).cogroup(right.select(*keys, "query", "vector").groupBy(*keys)).applyInArrow(scan, "query bigint, score double, ids array<bigint>")
    # of a vector's queries: k + 1 vectors, each with k + 1 ids at most
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    found = found.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).drop("rank")
    same = asking.join(one, "vector").select(F.col("id").alias("query_id"), "query")
    out = same.join(found, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
