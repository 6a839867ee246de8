"""Operator 13: phrase collocations, counted in HAT-tries.

A task counts the phrases of its texts in a shallow trie whose leaves are array hashes. A node routes by ranges of ids; a leaf that grows
too large is split, by halves of its range or, when it covers one id, by a node over the id after that. When a task holds too many
phrases, whole subtrees are written out as sorted runs. The runs of all tasks are dealt by ranges of phrases, so that a prefix is in one
or a few neighbouring partitions, and summed there.

Phrases grow by level: longer ones are counted only where all their words, then all their pairs, pass a filter of the frequent ones. The
filter is a bitmap of fixed size: it lets some rare phrases through, which the sums then drop, and never loses a frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, drop, save, slices, table, utf8
from .words import hashes, mix

LONGEST, LEAST, BEST = 4, 30, 2000
#: Phrases in a leaf before it is split; phrases and words in a task before subtrees are written out.
BURST, HELD, WORDS = 1 << 17, 3 << 20, 1 << 20
#: Bits of the filter of frequent phrases, as a power of two.
FILTER = 26
#: Bytes of text that are coded at a time.
SLICE = 2 << 20
UNKNOWN = "und"
#: A-Z lowered, tab as space, and everything that ends a piece as a byte that UTF-8 never has.
_BREAK = b"\xff"
_BYTES = bytes(0xFF if chr(i) in ".,;:!?\n\x0b\x0c\r" else 0x20 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
RUN_KIND = "lang string, size int, phrase binary, f bigint"
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


class ArrayHash:
    """A hash table in arrays: 64-bit keys by open addressing, each with a number. Keys are below the largest one."""

    def __init__(self, size: int = 1 << 14):
        self.keys, self.values, self.used = np.zeros(size, np.uint64), np.zeros(size, np.int64), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys, which get one where they have none."""
        wanted, mask = keys + np.uint64(1), np.uint64(len(self.keys) - 1)
        slot = (mix(wanted) & mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at, key = slot[left], wanted[left]
            held = self.keys[at]
            empty = held == 0
            if empty.any():
                # of several keys that claim a place the last one has it, and its like; the others go on
                place, claim = at[empty], np.arange(1, empty.sum() + 1)
                self.values[place] = claim
                won = self.values[place] == claim
                self.values[place] = 0
                self.keys[place[won]] = key[empty][won]
                self.used += int(won.sum())
                if 2 * self.used > len(self.keys):
                    self._grow()
                    return self.slots(keys)
                held = self.keys[at]
            left = left[held != key]
            slot[left] = (slot[left] + 1) & int(mask)
        return slot

    def _grow(self) -> None:
        keys, values = self.items()
        self.__init__(4 * len(self.keys))
        slot = self.slots(keys)
        self.values[slot] = values

    def count(self, keys: np.ndarray) -> int:
        """Add one to the number of each key, as often as it comes; how many keys are new."""
        before = self.used
        for lo in range(0, len(keys), 1 << 16):
            slot = self.slots(keys[lo : lo + (1 << 16)])
            np.add.at(self.values, slot, 1)
        return self.used - before

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; new keys get the next ones, from 0."""
        out = []
        for lo in range(0, len(keys), 1 << 16):
            before = self.used
            slot = self.slots(keys[lo : lo + (1 << 16)])
            new = np.unique(slot[self.values[slot] == 0])
            self.values[new] = np.arange(before + 1, before + 1 + len(new))
            out.append(self.values[slot] - 1)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        there = self.keys != 0
        return self.keys[there] - np.uint64(1), self.values[there]


def part_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """The id of keys at a depth: their upper half, then their lower half."""
    return (keys >> _HALF if depth == 0 else keys & _LOW).astype(np.int64)


class Node:
    """Children by ranges of the id at a depth: child k covers the ids from starts[k] to the next one's. A child is a node or a leaf."""

    def __init__(self, depth: int = 0):
        self.depth, self.starts, self.children = depth, np.zeros(1, np.int64), [ArrayHash()]

    def add(self, keys: np.ndarray, burst: int) -> int:
        """Count keys; how many are new."""
        if len(self.children) == 1:
            return self._to(0, keys, burst)
        to = np.searchsorted(self.starts, part_of(keys, self.depth), "right") - 1
        order = np.argsort(to, kind="stable")
        keys, to = keys[order], to[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
        # from the last child on, as a split moves those after it
        return sum(self._to(int(to[edges[i]]), keys[edges[i] : edges[i + 1]], burst) for i in range(len(edges) - 2, -1, -1))

    def _to(self, child: int, keys: np.ndarray, burst: int) -> int:
        below = self.children[child]
        if isinstance(below, Node):
            return below.add(keys, burst)
        new = below.count(keys)
        if below.used > burst:
            self._split(child, burst)
        return new

    def _split(self, child: int, burst: int) -> None:
        keys, values = self.children[child].items()
        ids = part_of(keys, self.depth)
        middle = int(np.partition(ids, len(ids) // 2)[len(ids) // 2])
        if middle == ids.min():
            above = ids[ids > middle]
            if not len(above):
                # one id: a node over the next, if there is a next
                if self.depth == 0:
                    below = Node(1)
                    below.children[0] = self.children[child]
                    self.children[child] = below
                    below._split(0, burst)
                return
            middle = int(above.min())
        halves = []
        for half in (ids < middle, ids >= middle):
            leaf = ArrayHash()
            for lo in range(0, int(half.sum()), 1 << 16):
                part = np.flatnonzero(half)[lo : lo + (1 << 16)]
                slot = leaf.slots(keys[part])
                leaf.values[slot] = values[part]
            halves.append(leaf)
        self.children[child : child + 1] = halves
        self.starts = np.insert(self.starts, child + 1, middle)

    def leaves(self) -> Iterator[ArrayHash]:
        """In the order of their ids."""
        for below in self.children:
            yield from below.leaves() if isinstance(below, Node) else (below,)


def _pieces(column: pa.BinaryArray) -> list[bytes]:
    """The values of a column without nulls; much faster than its own to_pylist()."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _folded(seed: np.uint64, words: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases from their words' hashes, as places in the filter."""
    x = np.full(len(words[0]), seed, np.uint64)
    for h in words:
        x = mix((x * _FOLD) ^ h)
    return (x >> np.uint64(64 - FILTER)).astype(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    raw = np.frombuffer(b"".join(words), np.uint8)
    return hashes(raw, at[:-1], at[1:])


def _seed(lang: str) -> np.uint64:
    return _hashes([lang.encode() + b"\n"])[0]


class Tries:
    """The phrases of one task: a trie a language and size, and the ids of its words. Keys of phrases of one word hold its id, of two
    words both ids; of three and four the numbers of their first and their last pair."""

    def __init__(self, burst: int, held: int, words: int):
        self.burst, self.held, self.most_words = burst, held, words
        self.seeds: dict[str, np.uint64] = {}
        self.clear()

    def clear(self) -> None:
        self.roots: dict[tuple[str, int], Node] = {}
        self.phrases = 0
        self.ids: dict[bytes, int] = {_BREAK: 0}
        self.hash = np.zeros(1, np.uint64)
        self.pairs = ArrayHash()

    def words_of(self, texts: list[bytes]) -> np.ndarray:
        """Ids of the words of texts in order, 0 where a piece ends."""
        b = np.frombuffer(_BREAK.join(texts).translate(_BYTES), np.uint8)
        inside, end = b != 32, b == 0xFF
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | end[:-1] | end[1:]
        data = b[inside]
        at = np.append(np.cumsum(inside)[begins] - 1, len(data)).astype(np.int32)
        # words are compared as bytes: equal ones once a call
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        each, ids = _pieces(coded.dictionary), self.ids
        new = [w for w in each if w not in ids]
        if new:
            ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
            self.hash = np.concatenate([self.hash, _hashes(new)])
        return np.fromiter(map(ids.__getitem__, each), np.int64, len(each))[coded.indices.to_numpy()]

    def passing(self, bits: np.ndarray, lang: str, parts: list[np.ndarray]) -> np.ndarray:
        """Whether the phrases of these words, by ids, pass the filter."""
        if lang not in self.seeds:
            self.seeds[lang] = _seed(lang)
        spots = _folded(self.seeds[lang], [self.hash[p] for p in parts])
        return (bits[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)

    def add(self, lang: str, size: int, keys: np.ndarray) -> None:
        if len(keys):
            self.phrases += self.roots.setdefault((lang, size), Node()).add(keys, self.burst)

    def full(self) -> bool:
        return self.phrases + self.pairs.used > self.held or len(self.ids) > self.most_words

    def runs(self) -> Iterator[pa.RecordBatch]:
        """All subtrees as sorted runs; nothing is kept."""
        listed = list(self.ids)
        words = pa.array(listed, pa.binary())
        rank = np.empty(len(listed), np.int64)
        rank[pa.compute.array_sort_indices(words).to_numpy()] = np.arange(len(listed))
        keys, numbers = self.pairs.items()
        pair = np.empty(len(keys), np.uint64)
        pair[numbers - 1] = keys
        for lang, size in sorted(self.roots):
            for leaf in self.roots[lang, size].leaves():
                keys, counts = leaf.items()
                for lo in range(0, len(keys), 1 << 17):
                    key, f = keys[lo : lo + (1 << 17)], counts[lo : lo + (1 << 17)]
                    first, last = part_of(key, 0), part_of(key, 1)
                    if size > 2:
                        both = part_of(pair[last], 0), part_of(pair[last], 1)
                        parts = [part_of(pair[first], 0), part_of(pair[first], 1), *both[4 - size :]]
                    else:
                        parts = [first, last][:size]
                    ends = [(rank[a] << 32) | rank[b] for a, b in zip(parts[::2], [*parts[1::2], *([np.zeros(len(key), np.int64)] * (size % 2))], strict=True)]
                    order = np.argsort(ends[0]) if size < 3 else np.lexsort(ends[::-1])
                    spelled = [words.take(pa.array(p[order])) for p in parts]
                    phrase = spelled[0] if size == 1 else pa.compute.binary_join_element_wise(*spelled, b" ")
                    n = len(order)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), phrase, pa.array(f[order])], ["lang", "size", "phrase", "f"])
        self.clear()


def frequent_filter(found: DataFrame) -> np.ndarray:
    """The bitmap of phrases (lang, phrase), 2^FILTER bits whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER - 3), np.uint8)
        for batch in batches:
            by: dict[tuple[str, int], list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = phrase.split(b" ")
                by.setdefault((lang, len(words)), []).append(words)
            for (lang, size), rows in by.items():
                spots = _folded(_seed(lang), [_hashes([r[k] for r in rows]) for k in range(size)])
                np.bitwise_or.at(bits, spots >> 3, np.uint8(1) << (spots & 7).astype(np.uint8))
        words = bits.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], ["at", "bits"])

    own = found.select("lang", "phrase").mapInArrow(run, "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER - 6), np.int64)
    words[own.column("at").to_numpy()] = own.column("bits").to_numpy()
    return words.view(np.uint8)


def counted(texts: DataFrame, sizes: tuple[int, ...], kept=None, burst: int = BURST, held: int = HELD, words: int = WORDS) -> DataFrame:
    """Sorted runs (lang, size, phrase, f) of texts (lang, text): all words; pairs of words that pass the filter kept (a broadcast of the
    bitmap of the level below); phrases of three and four words all of whose pairs do."""

    def level(tries: Tries, lang: str, ids: np.ndarray) -> None:
        whole = ids > 0
        wide = ids.astype(np.uint64)
        if sizes == (1,):
            tries.add(lang, 1, wide[whole] << _HALF)
            return
        if sizes == (2,):
            whole[whole] = tries.passing(kept.value, lang, [ids[whole]])
            both = whole[:-1] & whole[1:]
            tries.add(lang, 2, (wide[:-1][both] << _HALF) | wide[1:][both])
            return
        both = whole[:-1] & whole[1:]
        both[both] = tries.passing(kept.value, lang, [ids[:-1][both], ids[1:][both]])
        number = np.zeros(len(both), np.uint64)
        number[both] = tries.pairs.numbers((wide[:-1][both] << _HALF) | wide[1:][both]).astype(np.uint64)
        for size in sizes:
            n = len(both) - size + 2
            if n < 1:
                continue
            run = np.logical_and.reduce([both[k : k + n] for k in range(size - 1)])
            tries.add(lang, size, (number[:n][run] << _HALF) | number[size - 2 : size - 2 + n][run])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Tries(burst, held, words)
        for batch in batches:
            raw, at = utf8(batch.column(1))
            names = batch.column(0).to_pylist()
            for lo, hi in slices(at, SLICE):
                by: dict[str, list[bytes]] = {}
                for i in range(lo, hi):
                    by.setdefault(names[i], []).append(raw[at[i] : at[i + 1]].tobytes())
                for lang, some in by.items():
                    level(tries, lang, tries.words_of(some))
                if tries.full():
                    yield from tries.runs()
        yield from tries.runs()

    return texts.mapInArrow(run, RUN_KIND)


def merged(runs: DataFrame) -> DataFrame:
    """The sums of sorted runs. Phrases are dealt by ranges, which are what the sums are grouped by: they move once."""
    return runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.max("size").alias("size")).select("lang", "size", "phrase", "f")


def frequent_phrases(docs: DataFrame, least: int = LEAST, **limits: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """All phrases of one to LONGEST words (lang, size, phrase, f) that occur least times or more in a language; the words a language
    (lang, n); and the scratch folders they read."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    found, paths, kept, totals = [], [], None, None
    for sizes in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        runs, path = save(counted(texts, sizes, kept, **limits))
        if totals is None:
            totals, total_path = save(runs.groupBy("lang").agg(F.sum("f").alias("n")))
            paths.append(total_path)
        level, level_path = save(merged(runs).where(F.col("f") >= least))
        drop(spark, path)
        if kept is not None:
            kept.unpersist()
        found.append(level)
        paths.append(level_path)
        if sizes[-1] < LONGEST:
            kept = spark.sparkContext.broadcast(frequent_filter(level))
    every = found[0]
    for level in found[1:]:
        every = every.union(level)
    return every.withColumn("phrase", F.col("phrase").cast("string")), totals, paths


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, **limits: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to four words that occur least times or more.

    Texts are lower-cased (A-Z), split at .,;:!? and line ends into pieces and those at spaces and tabs into words; a is the number of
    times that a phrase occurs within pieces, l and r those of the two parts of its cut, n all words of the language. The score is
    floor(2000000 a / (l + r)) of the cut where that is lowest, of several the first. Phrases within a longer one that occurs four times
    for every five of theirs are left out. Ranks go by score, a, and phrase (its bytes). A null lang is `und`; null and empty texts have
    no words; every row counts, repeated ones again; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    every, totals, _ = frequent_phrases(docs, least, **limits)
    long = every.where(F.col("size") > 1).select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda first, count: F.array_join(F.slice(F.col("w"), first, count), " ")
    cuts = long.select("lang", "size", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # products may pass 64 bits: whole numbers of 38 digits
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = long.where(F.col("size") > 2).select("lang", "size", "w", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("words"))
    inner = inner.select("lang", "w", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("words") + 1)).alias("at"))
    inner = inner.select("lang", part(F.col("at"), F.col("words")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 80))
    own = own.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("bigint").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: DuckDB SQL of the query: every phrase of every piece is counted.
OP13_SQL = r"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
sized as (select lang, i, w, unnest([1, 2, 3, 4]) as size from starts),
counts as materialized (
  select lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase, count(*) as f
  from sized where i + size - 1 <= len(w) group by all having count(*) >= 30),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
long as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from counts where size > 1),
cuts as (select lang, size, phrase, a, w, unnest(range(1, size)) as k from long),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, ((2000000::hugeint * c.a) // (x.f + y.f))::bigint as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = array_to_string(list_slice(c.w, 1, c.k), ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(list_slice(c.w, c.k + 1, c.size), ' ')),
lowest as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as o from scored) where o = 1),
parts as (select lang, a, w, size, words, unnest(range(1, size - words + 2)) as i from (select lang, a, w, size, unnest(range(2, size)) as words from long where size > 2)),
inner_of as (select lang, array_to_string(list_slice(w, i, i + words - 1), ' ') as phrase, max(a) as longer from parts group by all),
kept as (select lowest.* from lowest left join inner_of using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept) join totals using (lang) where rank <= 2000
"""
