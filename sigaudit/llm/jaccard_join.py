"""Operator 3: exact n-gram Jaccard self-join by signature trees, with connected components.

1. Every text becomes its set of word-shingle hashes; equal sets are one class, represented by its smallest doc_id.
2. Two sets that link share a token among the first n - ceil(t n) + 1 of each under any common order (tokens that most documents
   share go last). So classes meet in cells, one a shared prefix token, and no link is lost.
3. Cells are joined by signature trees, in two rounds. First each class goes only to its first shared token's cell, split into
   bounded blocks that all hold the cell's smallest class: this finds most links and so most components. Then every cell that
   still holds several components is searched in full, all pairs of blocks, for links between different components: by bitmaps
   first, and then with the texts of the rows that those can't rule out.
Links inside a component are never listed, so a group of copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, drop, lean, save, slices, table, utf8
from .components import components
from .signature_tree import bitmap, chunks, tree_labels, tree_pairs, width_for
from .words import shingles

#: Tokens put last in the order, at most; and in how many prefixes one must be found for that. Any choice gives the same links.
COMMON, COMMON_FROM = 50_000, 16
#: Weight of one block of a cell: each set counts its shingles and ROW, so that a block has a thousand sets at most.
BLOCK, ROW = 1 << 20, 1 << 10
#: Bytes of text whose shingles are made at a time: the arrays for it take some forty times as much.
SLICE = 1 << 18


def _tokens(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32).view(np.int32)


def prefixes(docs: DataFrame, k: int, percent: int, last: np.ndarray) -> DataFrame:
    """doc_id, n, set_key (equal for equal sets only), prefix (tokens), bits (the token bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for lo, hi in slices(at, SLICE):
                sets = shingles(raw, at[lo : hi + 1], k)
                keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                found = []
                for x in sets:
                    tokens = _tokens(x)
                    if len(last) and len(x):
                        place = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
                        common = last[place] == tokens
                        tokens = np.concatenate([tokens[~common], tokens[common]])
                    found.append(tokens[: len(x) + (-percent * len(x) // 100) + 1] if len(x) else tokens)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())), pa.array([bitmap(x, width_for(len(x))).tobytes() if len(x) else None for x in sets], pa.binary())],
                    ["doc_id", "n", "set_key", "prefix", "bits"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id bigint, n bigint, set_key binary, prefix array<int>, bits binary")


#: Bits of the filter that keeps most texts of no interest from being shuffled, for each id and at most (16 MB to broadcast).
FILTER_EACH, FILTER_MOST = 16, 1 << 27


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (doc_id, text) without most rows whose doc_id is not in ids: a Bloom filter sized by their number, put together by Spark.
    So many ids that it would let most texts through are left to the join."""
    n = ids.select(F.approx_count_distinct("doc_id")).first()[0]
    size = max(1 << 16, 1 << (FILTER_EACH * n).bit_length())
    if size > 4 * FILTER_MOST:
        return docs.where("doc_id is not null").select("doc_id", "text")
    size = min(size, FILTER_MOST)
    bit = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(size))
    words = ids.select(bit().alias("b")).select((F.col("b") / 64).cast("bigint").alias("word"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("mask")).groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()
    filled = np.zeros(size // 64, np.int64)
    filled[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(2).to_numpy()
            hit = (sent.value[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(hit.astype(bool)))

    return docs.where("doc_id is not null").select("doc_id", "text", bit().alias("b")).mapInArrow(lean(run), "doc_id bigint, text string")


KEYS = ["token", "one", "two"]


def _values(column: pa.Array) -> list:
    """The values of a column; lists of numbers as arrays, which take a tenth of the memory of a list's numbers."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    every, at = column.flatten().to_numpy(), column.offsets.to_numpy()
    return [every[a:z].copy() for a, z in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]


def _by_block(rows: DataFrame, columns: list[str], work, kind: str) -> DataFrame:
    """work(key, rows) over the rows of each (token, one, two), which are streamed together: a block is bounded, a partition need not
    be. work gives tuples of kind."""
    schema = rows.sparkSession.createDataFrame([], kind).schema
    arrow = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.int32() for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(arrow)], names=schema.names)

        for batch in batches:
            out: list[tuple] = []
            lists = [_values(c) for c in batch.columns]
            for x, row in zip(zip(*lists[:3], strict=True), zip(*lists[3:], strict=True), strict=True):
                if x != key:
                    out += work(key, held) if len(held) > 1 else []
                    key, held = x, []
                held.append(row)
            yield sent(out)
        yield sent(work(key, held) if len(held) > 1 else [])

    return rows.select(*KEYS, *columns).repartition(*KEYS).sortWithinPartitions(*KEYS, "doc_id").mapInArrow(lean(run), schema)


def _links(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """rows: token, one, two (the block pair; one = two: a block with itself), side, component, doc_id, text. For each set of components
    that links join in a block or pair of blocks, (a, b) from a document of each to the smallest such document."""

    def work(key: tuple, block: list[tuple]) -> list[tuple]:
        ids, comps, sides, texts = zip(*block, strict=True)
        raw, at = utf8(pa.array(texts, pa.large_string()))
        sets = [s for lo, hi in slices(at, SLICE) for s in shingles(raw, at[lo : hi + 1], k)]
        side, comp = np.array(sides), np.unique(comps, return_inverse=True)[1]
        label = tree_labels(sets, comp, percent, side if side.any() else None)
        head: dict[int, int] = {}
        first: dict[int, tuple[int, int]] = {}
        for i in sorted(range(len(ids)), key=ids.__getitem__):
            head.setdefault(label[i], ids[i])
            first.setdefault(comp[i], (label[i], ids[i]))
        return [(head[x], i) for x, i in first.values() if head[x] != i]

    return _by_block(rows, ["doc_id", "component", "side", "text"], work, "a bigint, b bigint")


def _smaller(tokens: list[np.ndarray], key: int) -> np.ndarray:
    """Per row a bitmap of its tokens below key that at least two rows hold."""
    rows = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    every = np.concatenate(tokens)
    rows, every = rows[every < key], every[every < key]
    place, count = np.unique(every, return_inverse=True, return_counts=True)[1:]
    slot = (np.cumsum(count > 1) - 1)[place]
    rows, place = rows[count[place] > 1], slot[count[place] > 1]
    bits = np.zeros((len(tokens), 1 + (place.max() // 64 if len(place) else 0)), np.uint64)
    np.bitwise_or.at(bits, (rows, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return bits


def _share(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair have a bit in common."""
    out = np.zeros(len(i), bool)
    for c in chunks(len(i), bits.shape[1] * 8):
        out[c] = (bits[i[c]] & bits[j[c]]).any(axis=1)
    return out


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """rows: as of _links, with n, bits and tokens (all cells of the class) in place of text. The rows (token, one, two, side, doc_id, component) that some pair
    needs: one that the tree over the bitmaps can't rule out, in the cell of the pair's smallest common token only."""

    def work(key: tuple, block: list[tuple]) -> list[tuple]:
        ids, comps, sides, sizes, bits, cells = zip(*block, strict=True)
        comp = np.unique(comps, return_inverse=True)[1]
        side, n = np.array(sides), np.array(sizes, np.int64)
        wide = np.array([len(x) * 8 for x in bits])
        smaller = _smaller(cells, key[0])
        need: set[int] = set()
        for w in np.unique(wide):
            # linked sets differ in size so little that their widths are equal or one step apart; wider maps are folded
            own = np.flatnonzero((wide == w) | (wide == 2 * w))
            maps = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[r], np.uint64).reshape(-1, w // 64), axis=0) for r in own])
            i, j = tree_pairs(maps, n[own], np.array([int(cells[r].min()) for r in own]), comp[own], percent)
            i, j = own[i], own[j]
            ok = (wide[i] == w) | (wide[j] == w)
            if side.any():
                ok &= side[i] != side[j]
            i, j = i[ok], j[ok]
            need.update(np.unique(np.concatenate([i, j])[np.tile(~_share(smaller, i, j), 2)]).tolist())
        return [(*key, side[r].item(), ids[r], comps[r]) for r in sorted(need)]

    return _by_block(rows, ["doc_id", "component", "side", "n", "bits", "tokens"], work, "token int, one int, two int, side int, doc_id bigint, component bigint")


#: Rows of a table that may be broadcast after a count, and places in which the rows of a token meet a larger one.
LISTED, SALTS = 200_000, 32


def _blocks(cells: DataFrame, full: bool) -> DataFrame:
    """cells: token, doc_id, n, component. Adds (one, two, side). A cell of weight up to BLOCK is one block. A larger one is dealt
    out by a hash: in full to all pairs of its blocks, else to its blocks, each with the cell's smallest class. Only the list of larger
    cells meets the rows: broadcast if it is short, else in SALTS places a token, so that a frequent token is no task's."""
    size = cells.groupBy("token").agg(F.sum(F.col("n") + ROW).alias("weight"), F.min("doc_id").alias("anchor")).where(F.col("weight") > BLOCK)
    large, _ = save(size.select("token", "anchor", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks")))
    if large.count() <= LISTED:
        met = cells.join(F.broadcast(large), "token", "left")
    else:
        spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = cells.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(spread, ["token", "salt"], "left").drop("salt")
    dealt = met.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    if full:
        other = F.explode(every)
        out = dealt.withColumn("other", other).withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
        return out.withColumn("side", F.when(F.col("one") == F.col("two"), 0).when(F.col("own") == F.col("one"), 1).otherwise(2))
    to = F.explode(F.when(F.col("doc_id") == F.col("anchor"), every).otherwise(F.array("own")))
    return dealt.withColumn("one", to).withColumn("two", F.col("one")).withColumn("side", F.lit(0))


def _one_document(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the classes (node) of the different texts of one doc_id, from rows (doc_id, node)."""
    least = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    return rows.join(least, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row doc_id, n_shingles and component_id: the smallest doc_id reachable by links of 100 * |A and B| >= percent * |A or B|.

    Null, empty and blank texts have no shingle and are linked with nothing; fewer than k words are one shingle. Ties are links.
    Rows with one doc_id are one document: each is returned with its own size, and what any of its texts is linked with is linked with
    all of them. Rows of a null doc_id are returned with their size and a null component. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = prefixes(docs, k, percent, np.zeros(0, np.int32)).select(F.explode("prefix").alias("token")).groupBy("token").count()
    last = counted.where(F.col("count") >= COMMON_FROM).orderBy(F.desc("count"), "token").limit(COMMON).toPandas()["token"].to_numpy(np.int32)
    every, every_at = save(prefixes(docs, k, percent, np.sort(last)))

    classes, classes_at = save(every.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "prefix", "bits")).alias("r")).select("set_key", "r.*"))
    tokens = classes.select("doc_id", "n", F.explode("prefix").alias("token"))
    # nearly every token is of one class only: structs are aggregated by sorting, in a fifth less memory than a hash table (207 of 255 MB)
    one = F.struct("doc_id")
    shared = tokens.groupBy("token").agg(F.min(one).alias("x"), F.max(one).alias("y")).where("x < y").select("token")
    cells, cells_at = save(tokens.join(shared, "token").select("token", "doc_id", "n"))

    first = cells.groupBy("doc_id").agg(F.min("token").alias("token"), F.min("n").alias("n")).withColumn("component", F.col("doc_id"))
    meeting = first.groupBy("token").count().where("count > 1").select("token")
    met, met_at = save(first.join(meeting, "token"))
    named = every.where("n > 0 and doc_id is not null").select("doc_id", "set_key").join(classes.select("set_key", F.col("doc_id").alias("node")), "set_key").select("doc_id", "node")
    early, early_at = save(_links(_blocks(met, False).join(_texts(docs, met), "doc_id"), k, percent).unionByName(_one_document(named)))
    groups, groups_at = components(early)

    named = cells.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    alike = named.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"), F.expr("bit_xor(xxhash64(doc_id))").alias("members"), F.expr("bit_xor(xxhash64(doc_id, 1))").alias("again")).where("x < y")
    mixed = alike.groupBy("x", "y", "size", "members", "again").agg(F.min("token").alias("token")).select("token")
    open_, open_at = save(named.join(mixed, "token"))
    own = open_.groupBy("doc_id").agg(F.collect_list("token").alias("tokens"))
    rows = _blocks(open_, True).join(classes.select("doc_id", "bits").join(own, "doc_id"), "doc_id")
    needed, needed_at = save(_candidates(rows, percent))
    late, late_at = save(_links(needed.join(_texts(docs, needed), "doc_id"), k, percent))
    drop(spark, met_at, cells_at, groups_at, needed_at, open_at)
    linked, _ = components(early.union(late))
    drop(spark, early_at, late_at)

    found = every.select("doc_id", "n", "set_key").join(classes.select("set_key", F.col("doc_id").alias("node")), "set_key", "left").join(linked, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    # the empty texts of a document go with its others; rows of null doc_id are groups of their own
    whole = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.min(own).over(whole).alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


#: DuckDB SQL of the query: all pairs of documents that share a shingle, and what is reachable by their links.
OP3_SQL = r"""
with recursive lowered as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
grams as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) end as g from lowered),
sets as materialized (select doc_id, list_distinct(flatten(list(g))) as g from grams group by doc_id),
rows_ as (select doc_id, unnest(g) as s from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from rows_ a join rows_ b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 85 * (len(x.g) + len(y.g) - n)),
both_ as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reach r join both_ l on l.a = r.b)
select s.doc_id, cast(len(s.g) as bigint) as n_shingles, min(r.b) as component_id from sets s join reach r on r.a = s.doc_id group by s.doc_id, s.g
"""
