"""Every audit query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sigaudit.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame, floats: set[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows in order, as text but for columns of floating-point numbers."""
    exact = sorted(set(frame.columns) - floats)
    text = frame[exact].astype(object).map(lambda v: "null" if v is None or v is pd.NA or v != v else str(int(v) if isinstance(v, float) and v == int(v) else v))
    numbers = frame[sorted(floats)].apply(pd.to_numeric).astype(float)
    order = pd.concat([text, numbers.round(3)], axis=1).sort_values([*exact, *sorted(floats)]).index
    return text.loc[order].reset_index(drop=True), numbers.loc[order].to_numpy()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    floats = {c for c in want.columns if want[c].dtype == float}
    (a, x), (b, y) = plain(got, floats), plain(want, floats)
    pd.testing.assert_frame_equal(a, b)
    assert np.allclose(x, y, atol=2e-6, equal_nan=True)  # the two round half-way cases differently
