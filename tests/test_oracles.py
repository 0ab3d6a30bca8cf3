"""Every query with an SQL counterpart gives the same rows in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v is None or v != v else v for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: [(v is not None, v) for v in row])


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    want = duck.sql(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got_rows, want_rows = canonical(got), canonical(want)
    assert len(got_rows) == len(want_rows)
    for mine, theirs in zip(got_rows, want_rows):
        assert mine == pytest.approx(theirs, rel=1e-9, abs=2e-6, nan_ok=True) if all(
            isinstance(v, (int, float)) for v in mine) else mine == theirs or _close(mine, theirs)


def _close(mine, theirs):
    return all(
        abs(a - b) <= 2e-6 if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(mine, theirs)
    )


def test_entry_is_ranked(spark):
    rows = contract.entry(spark).collect()
    scores = [row.score for row in rows]
    assert scores == sorted(scores, reverse=True) and len(rows) > 0
