"""Queries against their oracles on keys as they occur in larger tables."""

import datetime
import re

import duckdb
import pandas as pd
import pytest

from bitquarry.plans import catalog as Q

USERS = [0, 1, 65535, 65536, 65537, 89999, 131072, 1 << 24, (1 << 33) + 5, -1, -65536, -65537]
KINDS = ["click", "view", "purchase", "error", "signup"]


def same(spark, sf_dir, name: str) -> None:
    ours = Q.QUERIES[name](spark, sf_dir)
    columns = ", ".join(sorted(ours.columns))
    con = duckdb.connect()
    for table in ("events", "orders", "lineitem"):
        if (sf_dir / f"{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    rows = lambda t: sorted(map(repr, t))
    assert rows(map(tuple, ours.select(*sorted(ours.columns)).collect())) == rows(con.execute(f"SELECT {columns} FROM ({Q.ORACLE_SQL[name]})").fetchall())


@pytest.fixture
def events(tmp_path):
    rows = [(k, user, kind, 7.25 * k) for k, (user, kind) in enumerate((u, e) for u in USERS for e in KINDS)]
    t = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "value"])
    t["ts"] = datetime.datetime(2024, 1, 1)
    t.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    return tmp_path


def test_users_above_sixteen_bits(spark, events):
    same(spark, events, "variant_event_payload")


def test_set_arm_of_users_above_sixteen_bits(spark, events):
    same(spark, events, "variant_set_and_make")


def test_set_arm_of_repeated_events(spark, events):
    t = pd.read_parquet(events / "events.parquet")
    t["event_id"], t["user_id"] = t["event_id"] // 3, t["user_id"] % 65536
    t.to_parquet(events / "events.parquet")
    same(spark, events, "variant_set_and_make")


def test_no_sketch_for_each_pair(spark, tmp_path):
    rows = [(order, line, 30.0, "RNA"[order % 3]) for order in (0, 7, 90000, 1 << 31) for line in range(1, 8) for _ in range(1 + line % 3)]
    pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]).astype({"l_linenumber": "int32"}).to_parquet(tmp_path / "lineitem.parquet")
    same(spark, tmp_path, "approx_distinct_decoded")
    plan = Q.QUERIES["approx_distinct_decoded"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\][^\n]*approx_count_distinct", plan)
    assert keys and not [k for k in keys if "orderkey" in k]
