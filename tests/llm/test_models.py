import numpy as np

from pyspark.sql import functions as F

from sigaudit.llm import language_id, quality_classifier
from sigaudit.llm.common import held_out
from sigaudit.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "  \n "), (4, "a"), (5, "word " * 50000), (6, "same text here"), (6, "same text here")]


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op1_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got.quality).mean() > 0.95 and ((got.score >= 0) & (got.score <= 1)).all()
    assert (got[got.quality == 1].predicted == 1).mean() > 0.97


def test_quality_edges(spark, docs_of, documents):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (1, None), (2, 7)], "doc_id bigint, quality int")
    model = quality_classifier.fit(documents, labels)
    got = quality_classifier.score(docs_of(EDGES), model)
    rows = got.select("doc_id", "quality_score").orderBy("doc_id").collect()
    assert len(rows) == 7 and all(0 <= r[1] <= 1 for r in rows) and rows[0][1] == rows[1][1] and rows[5] == rows[6]
    assert quality_classifier.classify(docs_of([]), labels).count() == 0
    no_labels = quality_classifier.classify(docs_of(EDGES), labels.where("false")).collect()
    assert {r["score"] for r in no_labels} == {0.5}
    null_id = quality_classifier.classify(docs_of([(None, "x y")]), labels).first()
    assert null_id["held_out"] is False


def test_grams_are_of_code_points():
    texts = ["日本語のテキスト", "ab é\tc", "", "x"]
    raw = [t.encode() for t in texts]
    b, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    kinds = quality_classifier.features(b, at)
    for t, i in zip(texts, range(4)):
        for k, (_, place) in zip(quality_classifier.GRAMS, kinds[-2:]):
            assert place[1, i] - place[0, i] == max(0, len(t) - k + 1)
    same = quality_classifier.features(np.frombuffer("ab é\tc日本語".encode(), np.uint8), np.array([0, 7, 16]))
    assert (same[-2][0][same[-2][1][0, 0] : same[-2][1][1, 0]] == kinds[-2][0][kinds[-2][1][0, 1] : kinds[-2][1][1, 1]]).all()


def test_scores_are_a_plain_forward_pass(docs_of, documents):
    """Average of vectors, softmax, document by document, against the projected sums of the scorer."""
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality_classifier.fit(documents, labels)
    rows = [tuple(r) for r in documents.limit(30).select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["quality_score"] for r in quality_classifier.score(docs_of(rows, extra=False), model).collect()}
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        kinds = quality_classifier.features(raw, np.array([0, len(raw)]))
        slots = np.concatenate([s[a[0, 0] : a[1, 0]] for s, a in kinds])
        hidden = model.vectors[slots].mean(axis=0) if len(slots) else np.zeros(quality_classifier.DIMENSIONS)
        logits = hidden @ model.layer + model.bias
        assert abs(got[i] - np.exp(logits[1]) / np.exp(logits).sum()) < 1e-4


def test_training_never_sees_held_out_labels(spark, documents):
    y = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = y.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.fit(documents, t) for t in (y, flipped))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.layer, b.layer)


def test_language_on_held_out_rows(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 60).select("doc_id", "lang")
    got = QUERIES["op2_language_id"](spark, SF).join(lang, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_language_edges(spark, docs_of):
    rng = np.random.default_rng(0)
    pieces = np.stack([np.frombuffer(bytes(rng.choice(list(a), 64).tolist()), np.uint8) for a in (b"abcd ", b"wxyz ") for _ in range(40)])
    net = language_id.train(pieces, np.repeat([0, 1], 40), ["first", "second"])
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "abca dabc"), (5, "zyx wzy " * 20000), (6, "zyx"), (6, "zyx")]
    got = [tuple(r) for r in language_id.identify(docs_of(rows), net).orderBy("doc_id").select("doc_id", "lang_pred").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "first"), (5, "second"), (6, "second"), (6, "second")]
    assert language_id.identify(docs_of([]), net).count() == 0
    assert language_id.fit(docs_of(EDGES[:3])) is None


def test_pooling_is_plain(docs_of):
    """A document's probabilities are the means over the places of all its pieces."""
    rng = np.random.default_rng(1)
    pieces = np.stack([np.frombuffer(bytes(rng.choice(list(a), 64).tolist()), np.uint8) for a in (b"abcd ", b"wxyz ") for _ in range(40)])
    net = language_id.train(pieces, np.repeat([0, 1], 40), ["first", "second"])
    texts = ["abcd wxyz " * 40, "ab", "z" * 64, "abca " * 13]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    many = language_id.document_probabilities(net, np.frombuffer(b"".join(raw), np.uint8), at)
    for i, x in enumerate(raw):
        alone = language_id.document_probabilities(net, np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        assert np.allclose(alone[0], many[i], atol=1e-5) and abs(many[i].sum() - 1) < 1e-4


def test_null_id_is_not_held_out(docs_of):
    net = None
    got = language_id.identify(docs_of([(None, "abc"), (None, None)]), net).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(None, "und")] * 2


def test_backpropagation_is_the_gradient():
    rng = np.random.default_rng(3)
    given = rng.normal(0, 0.4, (256, 3 * language_id.STATES)).astype(np.float32)
    state = rng.normal(0, 0.4, (language_id.STATES, 3 * language_id.STATES)).astype(np.float32)
    steps = rng.integers(0, 256, (6, 3))
    weight = rng.normal(size=(6, 3, language_id.STATES)).astype(np.float32)
    kept: list = []
    language_id.run_direction(given, state, steps, kept)
    d_given, d_state = language_id.back_direction(given, state, steps, kept, weight)
    value = lambda g, s: float((language_id.run_direction(g.astype(np.float32), s.astype(np.float32), steps).astype(np.float64) * weight).sum())
    for which, d in ((0, d_given), (1, d_state)):
        for _ in range(8):
            i = (steps.ravel()[rng.integers(18)] if which == 0 else rng.integers(language_id.STATES), rng.integers(3 * language_id.STATES))
            args = [given.astype(float), state.astype(float)]
            up, down = [a.copy() for a in args], [a.copy() for a in args]
            up[which][i] += 2e-2
            down[which][i] -= 2e-2
            assert abs((value(*up) - value(*down)) / 4e-2 - d[i]) < 0.05 * max(1, abs(d[i]))
