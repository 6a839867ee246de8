import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "longword " * 40000


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with clashing extra columns."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], KINDS)
        if extra:
            for c in ("score", "n", "token", "key", "component", "spans", "prefix", "group", "salt"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
