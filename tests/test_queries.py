"""Every telemetry query beside its DuckDB SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from beamloom.plans import oracles, queries
from tools.compare import plain

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for name in "part orders lineitem events embeddings".split():
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        found = db.sql(SQL[name])
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    else:
        tiles = df.select("tiles", "equal").collect()
        assert tiles and all(r.tiles == r.equal for r in tiles)


def beside_sql(spark, folder, name, table, rows):
    """Rows of a query over a table made of a SELECT, and of its SQL; columns in the query's order."""
    db = duckdb.connect()
    db.sql(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = queries.queries()[name](spark, str(folder))
    found = db.sql(SQL[name])
    order = [found.columns.index(c) for c in df.columns]
    return sorted((tuple(r) for r in df.collect()), key=repr), sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def test_q68_sql_knows_appends_that_overlap(spark, tmp_path):
    got, want = beside_sql(spark, tmp_path, "q68_inferred_times", "events", f"SELECT * FROM '{SF}/events.parquet' UNION ALL SELECT * FROM '{SF}/events.parquet' WHERE event_id % 3 = 0")
    assert got == want and Counter(r[3] for r in got)["overlap"] == sum(r[1] % 3 == 0 for r in got) // 2 > 0


def test_q78_sql_takes_the_axis_from_its_least_step(spark, tmp_path):
    got, want = beside_sql(spark, tmp_path, "q78_checked_intensity", "embeddings", "SELECT k AS vec_id, [1::FLOAT] AS embedding FROM range(100) t(k) WHERE k % 7 <> 3")
    assert got == want and got[0] == ("beam0", 34, 19, 326, 30.0)  # 20 places less 2, 9 and 16, in two channels


@pytest.mark.parametrize("apart, n, what", [(100_000, 3, "uneven time axis"), (15_000, 120, "time axis too long")])
def test_q78_sql_rejects_the_axes_that_the_query_rejects(spark, tmp_path, apart, n, what):
    db = duckdb.connect()
    db.sql(f"COPY (SELECT {apart} * k AS vec_id, [1::FLOAT, 2::FLOAT] AS embedding FROM range({n}) t(k)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    with pytest.raises(Exception, match=what):
        queries.q78_checked_intensity(spark, str(tmp_path)).collect()
    with pytest.raises(duckdb.Error, match=what):
        db.sql(SQL["q78_checked_intensity"]).fetchall()


def test_entries_agree():
    assert set(SQL) <= set(queries.queries())
