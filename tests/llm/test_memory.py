"""Memory of the Python workers: what a block of a join takes, and what a worker keeps after a task."""

import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from sigaudit.llm import jaccard_join, signature_tree

KEPT = """
import re, sys
import numpy as np, pyarrow as pa
from sigaudit.llm import jaccard_join

class Docs:
    def select(self, *a):
        return self
    def mapInArrow(self, run, kind):
        self.run = run
        return self

class Any:
    def __getattr__(self, name):
        return lambda *a: Any()

def private():
    return sum(map(int, re.findall("Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def sent():
    rng = np.random.default_rng(1)
    for _ in range(8):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 800)) for _ in range(1500)]
        out = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(texts)], ["doc_id", "text"])
        with pa.ipc.new_stream(out, batch.schema) as w:
            w.write_batch(batch)
        del texts, batch
        yield from pa.ipc.open_stream(out.getvalue().to_pybytes())

jaccard_join.F = Any()
docs = jaccard_join.prefixes(Docs(), 5, 80, np.zeros(0, np.int32))
before = private()
rows = sum(b.num_rows for b in docs.run(sent()))
assert rows == 12000
print(private() - before)
"""


def test_a_worker_keeps_little_after_a_task():
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    out = subprocess.run([sys.executable, "-c", KEPT], env=env, capture_output=True, text=True, check=True, timeout=120)
    assert float(out.stdout) < 90


def test_a_step_drops_what_another_kept(spark):
    from sigaudit.llm.bpe import LibraryCodec, codec
    from sigaudit.llm.bpe_coding import tokenizer_path
    from sigaudit.llm.common import lean

    path = tokenizer_path()

    def packs(batches):
        from sigaudit.llm.common import kept

        for b in batches:
            codec(path, LibraryCodec)
            yield pa.RecordBatch.from_arrays([pa.array([len(kept)] * b.num_rows, pa.int64())], ["id"])

    def joins(batches):
        from sigaudit.llm.common import kept

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(kept)] * b.num_rows, pa.int64())], ["id"])

    def most(run):
        return spark.range(64, numPartitions=8).mapInArrow(run, "id bigint").agg({"id": "max"}).first()[0]

    assert most(lean(packs, keeps=True)) == 1 and most(lean(joins)) == 0


def peak(work) -> float:
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_wide_bitmaps_are_compared_in_bounded_chunks():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2**63, (400, 2048)).astype(np.uint64)
    sizes = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    assert peak(lambda: signature_tree.tree_pairs(bits, sizes, np.arange(400), np.arange(400), 60, np.zeros(400, np.int64))) < 60
    i, j = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(400)))
    found = []
    assert peak(lambda: found.append(jaccard_join._share(bits, i, j))) < 60 and found[0].all()


def test_children_are_tested_as_they_are_made():
    rng = np.random.default_rng(4)
    n = 3000
    held = np.argsort(rng.random((n, 64)), axis=1)[:, :8]
    held[-20:] = held[:20]
    bits = np.bitwise_or.reduce(np.uint64(1) << held.astype(np.uint64), axis=1)[:, None]
    found = []
    assert peak(lambda: found.append(signature_tree.tree_pairs(bits, np.full(n, 8), np.arange(n), np.arange(n), 80, np.zeros(n, np.int64)))) < 60
    both = np.zeros((n, 64), np.int64)
    both[np.arange(n)[:, None], held] = 1
    both = both @ both.T
    want = {(int(a), int(b)) for a, b in np.argwhere(100 * both >= 80 * (16 - both)) if a < b}
    assert len(want) >= 20 and {(min(p), max(p)) for p in zip(found[0][0].tolist(), found[0][1].tolist(), strict=True)} == want


def test_smaller_tokens_are_those_that_two_rows_hold():
    rng = np.random.default_rng(3)
    tokens = [np.unique(rng.integers(-400, 400, 25)).astype(np.int32) for _ in range(60)] + [np.arange(10**6 * k, 10**6 * k + 5000, dtype=np.int32) for k in range(1, 101)]
    bits = jaccard_join._smaller(tokens, 2**31 - 1)
    assert bits.nbytes < 1 << 16
    i, j = np.triu_indices(len(tokens), 1)
    want = [len(np.intersect1d(tokens[a], tokens[b])) > 0 for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert jaccard_join._share(bits, i, j).tolist() == want
    assert not jaccard_join._smaller(tokens, -(2**31)).any()


def test_lists_of_a_batch_become_arrays():
    column = pa.array([[9], [1, 2], [], [3, 4, 5]], pa.list_(pa.int32())).slice(1)
    got = jaccard_join._values(column)
    assert [x.tolist() for x in got] == [[1, 2], [], [3, 4, 5]] and all(x.dtype == np.int32 for x in got)
