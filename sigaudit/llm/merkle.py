"""Operator 11: Merkle manifest of a table, a tree of SHA-256 midstates.

Leaves are numbered by ranges, and every run of PAGE leaves, or of tops of pages below, makes one page: a small tree in one row, in which
parents keep their children's digests and the hash state before each child slot. A leaf is proved or replaced by resuming those states:
only the replacement and the siblings to its right are hashed again, those to its left are in the state. No page grows with the input;
the number of tiers is the logarithm of the number of leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save, table
from .sha_lanes import absorb, as_block, finish, from_bytes, hex_of, start, to_bytes

#: Levels of a page, and children of a parent.
HEIGHT, ARITY = 12, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PAGE_KIND = "tree string, page bigint, levels int, digests binary, states binary, top binary"
#: One level of a path: the state before the child's slot, the digests before it and those after it.
PATH_KIND = "array<struct<state: binary, before: binary, after: binary>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """SHA-256 in hex of the values one after another, each `-` if null, else its bytes in UTF-8, `:` and itself."""
    return F.sha2(F.concat(*(_field(v) for v in values)).cast("binary"), 256)


def numbered(df: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, str]:
    """df with pos, the number of a row within its tree by order (from 0), and n, the rows of the tree; and the scratch folder it reads.
    Rows are sorted by ranges; only the number of rows a range and tree is looked at across ranges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for t in batch.column(batch.schema.get_field_index(tree)).to_pylist():
                seen = seen + 1 if t == last else 0
                last = t
                at.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array([part] * len(at), pa.int32())], [*batch.schema.names, "at", "part"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ranged, path = save(df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).mapInArrow(count, f"{kinds}, at bigint, part int"))
    sizes = ranged.groupBy(tree, "part").agg(F.count("*").alias("rows"))
    whole, before = Window.partitionBy(tree), Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(tree, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(whole).alias("n"))
    return ranged.join(starts, [tree, "part"]).withColumn("pos", F.col("first") + F.col("at")).drop("part", "at", "first"), path


def _levels(n: Column, arity: int) -> Column:
    """Levels above n leaves: the least power of arity that holds them, by whole numbers."""
    sizes = [arity**level for level in range(63) if arity**level < 1 << 62]
    return sum(((n > size).cast("int") for size in sizes), F.lit(0))


class Page:
    """The digests of every level of a page, (8, nodes), and the states before each slot but the first, (8, parents) each."""

    def __init__(self, digests: list[np.ndarray], states: list[list[np.ndarray]]):
        self.digests, self.states = digests, states

    @classmethod
    def build(cls, leaves: np.ndarray, levels: int, arity: int) -> Page:
        digests, states = [leaves], []
        for _ in range(levels):
            below = digests[-1]
            n = below.shape[1]
            parents = -(-n // arity)
            state, kept = start(parents), []
            for slot in range(arity):
                if slot:
                    kept.append(state.copy())
                child = below[:, slot::arity]
                if child.shape[1]:
                    state[:, : child.shape[1]] = absorb(state[:, : child.shape[1]], as_block(child))
            states.append(kept)
            digests.append(finish(state, np.minimum(arity, n - np.arange(parents) * arity)))
        return cls(digests, states)

    @classmethod
    def read(cls, n: int, levels: int, arity: int, digests: bytes, states: bytes) -> Page:
        sizes = [n]
        for _ in range(levels):
            sizes.append(-(-sizes[-1] // arity))
        every, at, levels_of = from_bytes(digests), 0, []
        for size in sizes:
            levels_of.append(every[:, at : at + size])
            at += size
        every, at, kept = from_bytes(states), 0, []
        for size in sizes[1:]:
            kept.append([every[:, at + s * size : at + (s + 1) * size] for s in range(arity - 1)])
            at += size * (arity - 1)
        return cls(levels_of, kept)

    def written(self) -> tuple[bytes, bytes]:
        return b"".join(map(to_bytes, self.digests)), b"".join(to_bytes(s) for kept in self.states for s in kept)

    def path(self, i: int, arity: int) -> list[dict]:
        """From node i of the lowest level to the top."""
        out = []
        for level, kept in enumerate(self.states):
            first, slot = i - i % arity, i % arity
            run = self.digests[level][:, first : first + arity]
            state = kept[slot - 1][:, i // arity : i // arity + 1] if slot else start(1)
            out.append({"state": to_bytes(state), "before": to_bytes(run[:, :slot]), "after": to_bytes(run[:, slot + 1 :])})
            i //= arity
        return out


def _resume(state: np.ndarray, run: np.ndarray, replacement: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """The parents' digests: run children each, of which right, the later ones of the run, follow the replacement; a later one may be
    wanting in the last lanes."""
    state = absorb(state, as_block(replacement))
    for sibling, there in right:
        state[:, there] = absorb(state[:, there], as_block(sibling))
    return finish(state, run)


def fold(page: Page, index: np.ndarray, replacement: np.ndarray, arity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of leaves index of a page: the page's top with each leaf replaced; the state of a hash over the siblings from the leaf up, left to
    right; and how many siblings that were."""
    proof, count = start(len(index)), np.zeros(len(index), np.int64)
    for level, kept in enumerate(page.states):
        below = page.digests[level]
        n, parent, slot = below.shape[1], index // arity, index % arity
        state = start(len(index))
        for s in range(1, arity):
            state[:, slot == s] = kept[s - 1][:, parent[slot == s]]
        right = []
        for s in range(arity):
            at = parent * arity + s
            there = (s != slot) & (at < n)
            proof[:, there] = absorb(proof[:, there], as_block(below[:, at[there]]))
            count += there
            later = there & (s > slot)
            if later.any():
                right.append((below[:, at[later]], later))
        replacement = _resume(state, np.minimum(arity, n - parent * arity), replacement, right)
        index = parent
    return replacement, proof, count


def _climb(replacement: np.ndarray, proof: np.ndarray, count: np.ndarray, path: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same above the page, where all lanes have one path; equal replacements are folded once."""
    _, first, which = np.unique(replacement.T, axis=0, return_index=True, return_inverse=True)
    few = np.ascontiguousarray(replacement[:, first])
    lanes = few.shape[1]
    for step in path:
        before, after = from_bytes(step["before"]), from_bytes(step["after"])
        for sibling in (*before.T, *after.T):
            proof = absorb(proof, np.repeat(as_block(sibling[:, None]), proof.shape[1], axis=1))
            count = count + 1
        right = [(np.repeat(x[:, None], lanes, axis=1), np.ones(lanes, bool)) for x in after.T]
        run = np.full(lanes, 1 + before.shape[1] + after.shape[1])
        few = _resume(np.repeat(from_bytes(step["state"]), lanes, axis=1), run, few, right)
    return few[:, which.ravel()], proof, count


def pages_of(nodes: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """One row a page of nodes (tree, pos, levels, digest), where levels are those still above the nodes."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        levels = group.column("levels")[0].as_py()
        page = Page.build(from_bytes(b"".join(group.column("digest").to_pylist())), min(height, levels), arity)
        digests, states = page.written()
        row = [[group.column("tree")[0].as_py()], [group.column("pos")[0].as_py() // arity**height], [levels], [digests], [states], [to_bytes(page.digests[-1])]]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["tree", "page", "levels", "digests", "states", "top"])

    return nodes.select("tree", "pos", "levels", "digest", F.floor(F.col("pos") / arity**height).alias("page")).groupBy("tree", "page").applyInArrow(build, PAGE_KIND)


def build(leaves: DataFrame, most: int, height: int = HEIGHT, arity: int = ARITY) -> tuple[list[DataFrame], list[str]]:
    """The tiers of pages over leaves (tree, pos, n, digest), lowest first, and their scratch folders. The last has a page a tree, whose
    top is the tree's root. most: leaves of the largest tree."""
    nodes = leaves.select("tree", "pos", _levels(F.col("n"), arity).alias("levels"), "digest")
    tiers, paths = [], []
    while True:
        pages, path = save(pages_of(nodes, height, arity))
        tiers.append(pages)
        paths.append(path)
        most = -(-most // arity**height)
        if most <= 1:
            return tiers, paths
        nodes = pages.select("tree", F.col("page").alias("pos"), F.greatest(F.col("levels") - height, F.lit(0)).alias("levels"), F.col("top").alias("digest"))


def _children(at: Column, height: int, arity: int) -> Column:
    return F.floor(at / arity**height)


def paths_down(tiers: list[DataFrame], above: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """For every page of the lowest tier (tree, page, path), the way from its top to the root; above: (tree, path) from a tree's root on."""

    def extend(own: pa.Table, over: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(over):
            levels = min(height, over.column("levels")[0].as_py())
            n = over.column("children")[0].as_py()
            page = Page.read(n, levels, arity, over.column("digests")[0].as_py(), over.column("states")[0].as_py())
            rest = over.column("path")[0].as_py()
            out = [page.path(i % arity**height, arity) + rest for i in own.column("page").to_pylist()]
        kind = pa.list_(pa.struct([("state", pa.binary()), ("before", pa.binary()), ("after", pa.binary())]))
        return pa.table([own.column("tree"), own.column("page"), pa.array(out, kind)], ["tree", "page", "path"])

    found = tiers[-1].select("tree", "page").join(above, "tree")
    for upper, lower in zip(tiers[:0:-1], tiers[-2::-1], strict=True):
        children = lower.groupBy("tree", _children(F.col("page"), height, arity).alias("page")).agg(F.count("*").alias("children"))
        over = upper.join(children, ["tree", "page"]).join(found, ["tree", "page"])
        own = lower.select("tree", "page", _children(F.col("page"), height, arity).alias("over"))
        found = own.groupBy("tree", "over").cogroup(over.groupBy("tree", "page")).applyInArrow(extend, f"tree string, page bigint, path {PATH_KIND}")
    return found


def manifest(docs: DataFrame, replacement: Column | None = None, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """Per row doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, as hex text; docs has the columns of FIELDS.

    Leaves ascend by doc_id (null first) within a lang, those of one doc_id by their digest, so that repeated rows are leaves of their
    own; langs ascend by their bytes, null first. A tree's levels join runs of arity nodes, the last run having fewer, even one. replacement
    is the hex digest that a leaf is folded with, null or absent for its own; verified says that the root is unchanged. Null and empty
    texts are told apart by the leaf. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    own = leaf(*(F.col(c) for c in FIELDS))
    other = F.lit(None).cast("string") if replacement is None else replacement
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(own).alias("digest"), F.unhex(other).alias("other"))
    # saved, as the ranges are found by a pass of their own and texts are to be hashed once
    leaves, passed = save(leaves)
    placed, _ = numbered(leaves, "tree", ["doc_id", "digest"])
    drop(docs.sparkSession, passed)
    most = placed.agg(F.max("n")).collect()[0][0] or 0
    tiers, _ = build(placed, most, height, arity)
    # the roots of the trees are the leaves of one more
    roots, _ = numbered(tiers[-1].select(F.lit("").alias("forest"), "tree", F.col("top").alias("digest")), "forest", ["tree"])
    roots = roots.select(F.col("forest").alias("tree"), "pos", "n", "digest", F.col("tree").alias("of"))
    upper, _ = build(roots, roots.count(), height, arity)
    none = F.array().cast(PATH_KIND)
    whole = upper[-1].select("tree", none.alias("path"))
    heads = paths_down(upper, whole, height, arity)
    counts = roots.groupBy("tree", _children(F.col("pos"), height, arity).alias("page")).agg(F.count("*").alias("children"))
    over = upper[0].join(counts, ["tree", "page"]).join(heads, ["tree", "page"])
    head = upper[-1].select("top").head()
    root = F.lit(bytes(head[0]) if head else None).cast("binary").alias("root")

    def head_paths(own: pa.Table, over: pa.Table) -> pa.Table:
        out = []
        if len(own):
            page = Page.read(over.column("children")[0].as_py(), min(height, over.column("levels")[0].as_py()), arity, over.column("digests")[0].as_py(), over.column("states")[0].as_py())
            rest = over.column("path")[0].as_py()
            out = [page.path(i % arity**height, arity) + rest for i in own.column("pos").to_pylist()]
        kind = pa.list_(pa.struct([("state", pa.binary()), ("before", pa.binary()), ("after", pa.binary())]))
        return pa.table([own.column("of"), pa.array(out, kind), own.column("digest")], ["tree", "path", "subroot"])

    trees = roots.withColumn("page", _children(F.col("pos"), height, arity)).groupBy("tree", "page").cogroup(over.groupBy("tree", "page")).applyInArrow(head_paths, f"tree string, path {PATH_KIND}, subroot binary")
    trees, _ = save(trees)
    found = paths_down(tiers, trees.select("tree", "path"), height, arity)
    lowest = tiers[0].join(found, ["tree", "page"]).join(trees.select("tree", "subroot"), "tree").select("*", root)

    def prove(own: pa.Table, page: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        n = len(own)
        digest = own.column("digest").to_pylist()
        at = np.arange(n)
        changed = [b if b is not None else a for a, b in zip(digest, own.column("other").to_pylist(), strict=True)]
        kept = Page.read(n, min(height, page.column("levels")[0].as_py()), arity, page.column("digests")[0].as_py(), page.column("states")[0].as_py())
        replaced, proof, count = fold(kept, at, from_bytes(b"".join(changed)), arity)
        replaced, proof, count = _climb(replaced, proof, count, page.column("path")[0].as_py())
        root, subroot, folded = page.column("root")[0].as_py().hex(), page.column("subroot")[0].as_py().hex(), hex_of(replaced)
        data = [own.column("doc_id"), [d.hex() for d in digest], [subroot] * n, [root] * n, hex_of(finish(proof, count)), folded, [x == root for x in folded]]
        return pa.table([data[0], *(pa.array(x, pa.string()) for x in data[1:6]), pa.array(data[6], pa.bool_())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    rows = placed.select("tree", _children(F.col("pos"), height, arity).alias("page"), "pos", "doc_id", "digest", "other")
    out = rows.groupBy("tree", "page").cogroup(lowest.groupBy("tree", "page")).applyInArrow(prove, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out


def tampered(every: int = 7) -> Column:
    """The leaf with 1 added to n_chars, where the crc32 of the decimal doc_id is divisible by every and n_chars is not null."""
    changed = leaf(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS))
    return F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0) & F.col("n_chars").isNotNull(), changed)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tampered())


#: crc32 of the decimal doc_id in DuckDB: every byte is followed by the eight shifts of its bits.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda d: [ascii(d)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"
#: DuckDB SQL of the query. Nodes of all levels are made by a recursion over levels; every leaf climbs them by another.
OP11_SQL = r"""
with recursive leaves as (
  select doc_id, coalesce('=' || lang, '') as tree, n_chars is not null and crc % 7 = 0 as touched,
    sha256(id || s || l || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') || t) as leaf,
    sha256(id || s || l || coalesce(octet_length(encode((n_chars + 1)::varchar)) || ':' || (n_chars + 1), '-') || t) as other
  from (select *, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') as id, coalesce(octet_length(encode(source)) || ':' || source, '-') as s,
          coalesce(octet_length(encode(lang)) || ':' || lang, '-') as l, coalesce(octet_length(encode(text)) || ':' || text, '-') as t, {crc} as crc from documents)),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from leaves),
nodes as (
  select tree, 0 as level, pos, leaf as h, count(*) over (partition by tree) as n from placed
  union all
  select tree, level + 1, pos // 2, sha256(h || coalesce(beside, '')), (n + 1) // 2
  from (select *, lead(h) over (partition by tree, level order by pos) as beside from nodes where n > 1) where pos % 2 = 0),
kept as materialized (select * from nodes),
heads as (select tree, level as height, h from kept where n = 1),
roots as (
  select 0 as level, row_number() over (order by encode(tree)) - 1 as pos, h, count(*) over () as n, tree from heads
  union all
  select level + 1, pos // 2, sha256(h || coalesce(beside, '')), (n + 1) // 2, null
  from (select *, lead(h) over (partition by level order by pos) as beside from roots where n > 1) where pos % 2 = 0),
above as materialized (select * from roots),
climb as (
  select doc_id, leaf, touched, tree, 0 as level, pos, pos as first, leaf as own, case when touched then other else leaf end as at, '' as proof, false as high from placed
  union all
  select c.doc_id, c.leaf, c.touched, c.tree, case when c.level = t.height and not c.high then 0 else c.level + 1 end,
    case when c.level = t.height and not c.high then r.pos else c.pos // 2 end, c.first, c.own,
    case when c.level = t.height and not c.high then c.at when c.pos % 2 = 0 then sha256(c.at || coalesce(k.h, a.h, '')) else sha256(coalesce(k.h, a.h) || c.at) end,
    case when c.level = t.height and not c.high then c.proof else c.proof || coalesce(k.h, a.h, '') end,
    c.high or c.level = t.height
  from climb c join heads t on t.tree = c.tree join above r on r.tree = c.tree and r.level = 0
  left join kept k on not c.high and k.tree = c.tree and k.level = c.level and c.level < t.height and k.pos = c.pos + 1 - 2 * (c.pos % 2)
  left join above a on c.high and a.level = c.level and a.pos = c.pos + 1 - 2 * (c.pos % 2)
  where not c.high or c.level < (select max(level) from above))
select c.doc_id, c.leaf, t.h as subroot, r.h as root, sha256(c.proof) as proof_sha256, c.at as folded_root, c.at = r.h as verified
from climb c join heads t on t.tree = c.tree join (select h from above where n = 1 and level = (select max(level) from above)) r on true
where c.high and c.level = (select max(level) from above)
""".replace("{crc}", CRC_SQL)
