import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sigaudit.llm import merkle, sha_lanes

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[k] is None else f"{len(str(row[k]).encode())}:{row[k]}" for k in merkle.FIELDS))


def climb(nodes, i, arity):
    """All levels' siblings (before, after) of node i, and the root."""
    path = []
    while len(nodes) > 1:
        first = i - i % arity
        path.append((nodes[first:i], nodes[i + 1 : first + arity]))
        nodes, i = [h(*nodes[j : j + arity]) for j in range(0, len(nodes), arity)], i // arity
    return path, nodes[0]


def brute(rows, arity=2):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        leaves[lang] = [leaf(r) for r in langs[lang]]
    subroots = [climb(leaves[lang], 0, arity)[1] for lang in order]
    out = []
    for k, lang in enumerate(order):
        for i, r in enumerate(langs[lang]):
            low, subroot = climb(leaves[lang], i, arity)
            high, root = climb(subroots, k, arity)
            path = low + high
            at = leaves[lang][i]
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                at = leaf(r | {"n_chars": r["n_chars"] + 1})
            for before, after in path:
                at = h(*before, at, *after)
            out.append((r["doc_id"], leaves[lang][i], subroot, root, h(*(s for b, a in path for s in b + a)), at, at == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


def test_lanes_hash_as_the_library():
    texts = [hashlib.sha256(str(i).encode()) for i in range(100)]
    lanes = sha_lanes.from_bytes(b"".join(t.digest() for t in texts))
    once = sha_lanes.absorb(sha_lanes.start(100), sha_lanes.as_block(lanes))
    twice = sha_lanes.absorb(once, sha_lanes.as_block(lanes))
    assert sha_lanes.hex_of(sha_lanes.finish(once, [1] * 100)) == [h(t.hexdigest()) for t in texts]
    assert sha_lanes.hex_of(sha_lanes.finish(twice, [2] * 100)) == [h(t.hexdigest() * 2) for t in texts]
    assert sha_lanes.hex_of(sha_lanes.finish(sha_lanes.start(1), [0])) == [h()]


@pytest.mark.parametrize("height,arity", [(2, 2), (2, 3)])
def test_manifest_against_brute_force(spark, height, arity):
    draw = random.Random(height * 10 + arity)
    rows = []
    for i in range(150):
        text = draw.choice([None, "", "é" * draw.randrange(40), f"text {i}"])
        rows.append({"doc_id": i * 3, "text": text, "lang": draw.choice([None, "", "en", "en", "en", "ü", "de"]), "source": draw.choice([None, "s", "7:x"]), "n_chars": None if text is None else len(text)})
    rows += [{"doc_id": 1000, "text": "alone", "lang": "zz", "source": None, "n_chars": 5}, {"doc_id": 3, "text": "again", "lang": "en", "source": "s", "n_chars": 5}]
    rows += [{"doc_id": None, "text": "no id", "lang": "en", "source": "s", "n_chars": 5}, {"doc_id": 9, "text": "x", "lang": "en", "source": "s", "n_chars": 1}] * 2
    docs = spark.createDataFrame([tuple(r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], KINDS)
    for c in ("tree", "pos", "page", "digest", "levels", "root", "n"):
        docs = docs.withColumn(c, F.lit("x"))
    got = rows_of(merkle.manifest(docs.repartition(7), merkle.tampered(), height, arity))
    assert got == brute(rows, arity)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(5, "t", "en", "s", 1), (5, "t", None, "s", 1)]])
def test_manifest_of_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, KINDS)
    assert rows_of(merkle.manifest(docs, merkle.tampered())) == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])


def test_own_leaf_proves_the_root(spark, documents):
    got = merkle.manifest(documents, None, 4)
    assert got.where("not verified or folded_root <> root").count() == 0 and got.select("root").distinct().count() == 1
    assert got.count() == documents.count()


def test_op11_equals_its_sql(spark, small, duck):
    want = sorted((tuple(r) for r in duck.sql(merkle.OP11_SQL).select(*NAMES).fetchall()), key=str)
    assert rows_of(merkle.op11_merkle_manifest(spark, small)) == want
