"""Every stage of the pipeline on empty, null, very long, repeated and clashing input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigaudit.llm.quality_classifier import features

STAGES = dict(corpus_pipeline.STAGES)
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINE = "one and the same line that stands in many of the documents, word for word"
GOOD = " ".join(f"word{i % 97}" for i in range(300))


def table(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], KINDS)
    for c in ("label", "score", "predicted", "key", "lost_lines", "component_id", "spans", "piece", "length", "sequence_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


ROWS = [(1, None), (2, ""), (3, GOOD), (3, GOOD), (4, GOOD + " end"), (5, "token = abcdefgh12 and more"), (None, GOOD), (None, None), (6, "long " * 60_000), *((i, f"{LINE}\n{GOOD} {i}") for i in range(10, 17)), (20, LINE), (21, " \n\t\n")]


def texts(df):
    return sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, small, name):
    out = STAGES[name](spark, table(spark, []), small)
    assert out.count() == 0
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS


def test_quality_stage_judges_each_row_by_its_text(spark, small):
    out = STAGES["quality_classifier"](spark, spark.read.parquet(f"{small}/documents.parquet").unionByName(table(spark, ROWS).select(*corpus_pipeline.COLUMNS)), small)
    kept = out.where("source = 's'")
    assert out.columns == corpus_pipeline.COLUMNS
    counts = {(r["doc_id"], r["text"]): r["count"] for r in kept.groupBy("doc_id", "text").count().collect()}
    # rows of one text stay or go together, whatever their id
    alike = [(3, GOOD), (None, GOOD)]
    assert counts.get(alike[0], 0) in (0, 2) and (counts.get(alike[0], 0) == 2) == (counts.get(alike[1], 0) == 1)
    assert ((1, None) in counts) == ((2, "") in counts) == ((None, None) in counts)


def test_line_stage(spark, small):
    got = texts(STAGES["line_dedup"](spark, table(spark, ROWS), small))
    assert len(got) == len(ROWS)
    want = []
    for i, t in ROWS:
        lost = i is not None and i != 20 and t is not None and LINE in t
        t = "\n".join(x for x in (t or "").split("\n") if not (lost and x == LINE))
        want.append((i, t, len(t)))
    assert got == sorted(want, key=str)


def test_near_copies_stage(spark, small):
    got = texts(STAGES["jaccard_join"](spark, table(spark, ROWS), small))
    ids = [i for i, _, _ in got]
    # 3 and 4 are near copies, and so are 10 to 16: the smallest stays, with all its rows; rows without an id stay
    assert sorted(ids, key=str) == sorted([1, 2, 3, 3, 5, 6, 20, 21, None, None], key=str)
    assert all((i, t, None if t is None else len(t)) in got for i, t in ROWS if i in (1, 2, 3, 5, 6, 21, None))


def test_secret_stage(spark, small):
    got = texts(STAGES["secret_scan"](spark, table(spark, ROWS), small))
    want = [(i, "[assign] and more" if i == 5 else t) for i, t in ROWS]
    assert got == sorted(((i, t, None if t is None else len(t)) for i, t in want), key=str)


def test_packing_stage(spark, small):
    rows = STAGES["packing"](spark, table(spark, ROWS), small).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {i for i, _ in ROWS} and len(by[3]) == 2 and len(by[None]) == 2 and all(r["length"] == 1 for r in by[1] + by[2])
    assert sum(r["length"] for r in by[6]) > 60_000 and max(r["length"] for r in rows) <= 1024
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024


@pytest.mark.parametrize("texts_", [["a b c", ""], ["a b c", "", ""], ["", "a"], ["a", ""], ["", ""], ["a b", "\t ", "c d", " "]])
def test_features_of_texts_without_words_at_the_end(texts_):
    raw = np.frombuffer("".join(texts_).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts_])])
    whole = features(raw, at)
    for i, t in enumerate(texts_):
        own = [sorted(s.tolist()) for s, _ in features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))]
        got = [sorted(s[a[0, i] : a[1, i]].tolist()) for s, a in whole]
        assert sorted(x for x in got if x) == sorted(x for x in own if x)
