"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, name):
    found = registry.queries()[name](spark, SF)
    cur = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, cur.fetchall())


def test_all_have_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_gains_of_odd_values_match_sql(spark, tmp_path):
    """Black has gain 1 however far from its median, and a quotient halfway between two sixth decimals goes where SQL rounds it."""
    series = [[0.0, 68.64, 68.64, 68.64], [5e-7, 40.0, 41.5], [-3.0, 40.0, 41.5, None], [None, 50.0, 80.0, float("nan")], [64.0, 66.1, 66.1], [0.0, 9.0]]
    series += [[a, b, b] for a in (32.0, 64.0, 128.0) for b in (a + i / 100 for i in range(100, 500))]
    found = [(i * 10 + j, i, v) for i, values in enumerate(series) for j, v in enumerate(values)]
    spark.createDataFrame(found, "event_id bigint, user_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(registry.oracle_sql()["luma_gain_clip"]).fetchall())
    got = {r["event_id"]: r["gain"] for r in registry.queries()["luma_gain_clip"](spark, str(tmp_path)).collect()}
    assert want[0] == 1.0 and want[1] == 1.0 and got == want
