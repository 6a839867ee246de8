import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigaudit.llm import collocations, neighbours

KINDS = "vec_id bigint, embedding array<float>, label int"


def brute_neighbours(rows, every, k):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in sorted(i for i in ok if i % every == 0):
        out[q] = sorted((float(np.sqrt(((ok[i] - ok[q]) ** 2).sum())), i) for i in ok if i != q)[:k]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return dict(out)


def recall(got, want):
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))


def test_op12_recall_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, want = found(neighbours.op12_neighbours(spark, "/root/testdata/sf0.1")), brute_neighbours(rows, 100, 10)
    assert recall(got, want) >= 0.9
    exact = {q: dict((i, s) for s, i in brute_neighbours([r for r in rows], 100, 2000)[q]) for q in list(want)[:3]}
    for q in exact:
        assert all(s == pytest.approx(exact[q][i], abs=1e-12) for s, i in got[q]) and got[q] == sorted(got[q])


def test_neighbours_of_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(60)]  # copies, many of them queries
    rows += [(300 + i, [1.0 if j == i % 6 else 0.0 for j in range(6)]) for i in range(12)]  # ties
    rows += [(400, None), (405, []), (410, [0.0] * 6), (415, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (420, [float("nan")] * 6), (425, [float("inf")] * 6), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows] + [(5, rows[5][1], 2)], KINDS)
    for c in ("id", "vector", "list", "query", "block", "part", "rank", "width"):
        df = df.withColumn(c, F.lit("x"))
    # every list is scanned, in blocks of a few vectors and queries: the result is exact
    got = found(neighbours.nearest_neighbours(df, F.col("id") % 5 == 0, 4, aim=1.0, block=7, some_queries=3))
    want = brute_neighbours(rows, 5, 4)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] or [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-9)
    assert [i for _, i in got[100]] == [0, 101, 102, 103] and [i for _, i in got[0]] == [100, 101, 102, 103]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0])], [(0, None)]])
def test_neighbours_of_few_rows(spark, rows):
    got = found(neighbours.nearest_neighbours(spark.createDataFrame([(i, v, 1) for i, v in rows], KINDS), F.col("id") % 100 == 0))
    assert got == ({0: [(0.0, 1)]} if len(rows) == 3 else {})


def test_scan_abandons_rows_and_keeps_the_nearest():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((20000, 64)) * 0.1 + rng.standard_normal((20, 64))[rng.integers(0, 20, 20000)]
    turn = neighbours.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    turned = rows @ turn
    columns = [np.ascontiguousarray(turned[:, i : i + 16]) for i in range(0, 64, 16)]
    hits = 0
    for i in range(50):
        kept = neighbours.adaptive_scan(turned[i], columns, 10)
        assert len(kept) < 40
        hits += len(set(kept.tolist()) & set(np.argsort(((rows - rows[i]) ** 2).sum(1))[:10].tolist()))
    assert hits >= 0.98 * 500


def brute_phrases(rows, least=30, best=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in wanted.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows = []
        for p, a in wanted.items():
            if p in longer and 100 * longer[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_op13_equals_its_sql(spark, small, duck):
    want = sorted(duck.sql(collocations.OP13_SQL).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").fetchall())
    assert len(want) > 40 and phrases(collocations.op13_collocations(spark, small)) == want


@pytest.mark.parametrize("limits", [{}, {"burst": 5, "held": 300, "words": 60}])
def test_collocations_against_brute_force(spark, limits):
    draw = random.Random(3)
    words = ["a", "B", "ça", "d'e", "f\x00", "g h", "İ", "x" * 300] + [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(150):
        text = "".join(draw.choice(words[: draw.randrange(2, len(words))]) + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n", "?"]) for _ in range(draw.randrange(90)))
        rows.append((draw.choice(["en", "en", "fr", None, "und", ""]), draw.choice([text, text, text + " the same end of it all", None, ""])))
    rows += [("hot", "Once more the same passage, again and again the same passage " * 200)] * 3
    df = spark.createDataFrame([(i, t, lang, "s", 0, "x", "x", "x") for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, phrase string, f string, size string")
    got = phrases(collocations.collocations(df.repartition(3), 5, 50, **limits))
    assert got == brute_phrases(rows, 5, 50) and {r[0] for r in got} >= {"en", "fr", "und", "hot"}


def test_collocations_of_nothing(spark):
    kind = "doc_id bigint, text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], kind)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " .\n", "en")], kind), 1).count() == 0


def test_scores_of_counts_beyond_64_bits(spark):
    q = "cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"
    a, left, r = 9 * 10**17 + 7, 3 * 10**18 + 1, 9 * 10**18 + 11
    assert spark.createDataFrame([(a, left, r)], "a bigint, l bigint, r bigint").select(F.expr(q)).head()[0] == 2000000 * a // (left + r)


def test_trie_bursts_and_keeps_all_counts():
    draw = np.random.default_rng(2)
    node = collocations.Node()
    want, new = Counter(), 0
    for _ in range(40):
        rows = np.minimum(draw.zipf(1.3, (3000, 2)), 4000).astype(np.uint64)
        rows[:900, 0] = 7  # one id in a leaf of its own, which is split by the next
        keys = (rows[:, 0] << np.uint64(32)) | rows[:, 1]
        new += node.add(keys, 50)
        want.update(keys.tolist())
    leaves, got = list(node.leaves()), Counter()
    for leaf in leaves:
        got.update(dict(zip(*(x.tolist() for x in leaf.items()), strict=True)))
    assert got == want and new == len(want) and len(leaves) > 50 and any(isinstance(c, collocations.Node) for c in node.children)
    assert max(leaf.used for leaf in leaves) <= 50
    firsts = [collocations.part_of(leaf.items()[0], 0) for leaf in leaves if leaf.used]
    assert all(a.max() <= b.min() for a, b in zip(firsts, firsts[1:]))


def test_array_hash():
    draw = np.random.default_rng(3)
    table, seen = collocations.ArrayHash(), {}
    for n in (0, 1, 5, 3000, 200000, 7):
        keys = draw.integers(0, 50000, n).astype(np.uint64) << np.uint64(30)
        got = table.numbers(keys)
        for k, v in zip(keys.tolist(), got.tolist(), strict=True):
            assert seen.setdefault(k, v) == v
    assert sorted(seen.values()) == list(range(table.used))
