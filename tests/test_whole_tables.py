"""Queries over whole tables, at a size where an id prefix is only a part."""

import duckdb

from brindle.plans import queries

DATA = "/root/testdata/sf0.01"


def test_explode_json_reaches_all_events(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    got = sorted((r["event_id"], str(r["item"])) for r in queries.QUERIES["explode_json"](spark, DATA).collect())
    assert got == sorted((i, str(x)) for i, x in con.execute(queries.ORACLE["explode_json"]).fetchall())
    assert max(i for i, _ in got) >= 1000


def test_fan_out_joins_all_events(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    got = {r["k"]: r["pairs"] for r in queries.QUERIES["join_fan_out"](spark, DATA).collect()}
    assert got == dict(con.execute("SELECT user_id, COUNT(*) * COUNT(*) FROM events WHERE user_id IS NOT NULL GROUP BY user_id").fetchall())
