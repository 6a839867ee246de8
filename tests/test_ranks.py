import numpy as np
import pytest
from pyspark.sql import functions as F

from sigaudit.functions import text
from sigaudit.operators import ranks


def brute(rows, column):
    keys = sorted({r["key"] for r in rows})
    out = {}
    for k in keys:
        v = [r[column] for r in rows if r["key"] != k and r[column] is not None]
        out[k] = float(np.median(v)) if v else None
    return out


@pytest.mark.parametrize("bins", [4, 512])
def test_medians_of_others_with_many_equal_values(spark, bins, monkeypatch):
    monkeypatch.setattr(ranks.binned, "__defaults__", (bins,))
    rng = np.random.default_rng(bins)
    rows = [
        {"key": f"s{int(rng.zipf(1.6)) % 9}", "constant": 3.5, "two": float(rng.integers(0, 2)), "few": float(rng.integers(0, 5)) if rng.random() > 0.2 else None, "many": float(rng.normal()), "lone": float(i) if i % 50 == 0 else None}
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "key string, constant double, two double, few double, many double, lone double")
    got = {(r["key"], r["f"]): r["median"] for r in ranks.left_out_medians(df, ["constant", "two", "few", "many", "lone"], "key").collect()}
    for column in ("constant", "two", "few", "many", "lone"):
        for key, want in brute(rows, column).items():
            assert got.get((key, column)) == (pytest.approx(want) if want is not None else None), (key, column)


def test_a_value_is_found_without_a_row_for_each_time_it_occurs(spark):
    counts = [1, 1, 7, 100_000_000, 3, 64, 1]
    upto = np.cumsum(counts)
    ordered = spark.createDataFrame([("f", 0, float(i), c, int(u)) for i, (c, u) in enumerate(zip(counts, upto, strict=True))], "f string, bin int, v double, c bigint, upto bigint")
    at = sorted({int(x) for u in upto for x in (u - 2, u - 1, u) if x >= 0} | {0, 1, 2, 50_000_000})
    wanted = spark.createDataFrame([("f", 0, a) for a in at], "f string, bin int, at bigint")
    got = {r["at"]: r["v"] for r in ranks.value_at(ordered, wanted, int(upto[-1])).collect()}
    assert got == {a: float(np.searchsorted(upto, a, "right")) for a in at if a < upto[-1]}


def test_bracket_lists(spark):
    rows = [("[Steps]: [1, 2,]",), ("[1, , 2] [Steps]: [1, , 2]",), ("[Steps]: [ , ]",), ("[Steps]: []",), ("none",), (None,), ("[Steps]: [1.5, x, -2e1]",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.bracket_list(F.col("t"), "Steps")).collect()]
    assert got == [[1.0, 2.0], [1.0, 2.0], None, None, None, None, [1.5, None, -20.0]]


def test_votes_and_texts_share_the_medians(spark, small, monkeypatch):
    from sigaudit.plans import audit

    seen, given = [], ranks.binned
    monkeypatch.setattr(ranks, "binned", lambda *a: seen.append(a[1]) or given(*a))
    out = audit.vote_vs_model(spark, small)
    assert seen == [[f"{c}__real" for c in audit.FEATURES]]  # once for both
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "pythonUDF" not in plan  # one saved table, met twice; nothing is scored or looked up again
