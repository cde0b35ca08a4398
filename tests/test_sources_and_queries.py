"""Framed files, streams, and every registered query against its oracle."""

import os

import duckdb
import pandas as pd
import pytest

from bitquarry.operators import packed
from bitquarry.plans import catalog as Q
from bitquarry.schema.compiler import compile_text
from bitquarry.schema.nodes import encode_one
from bitquarry.sources import framed

SF = "/root/testdata/sf0.001"
TEXT = "types: {m: {kind: object, fields: {id: u32, name: {kind: b5_string, max_length: 60}}}}"


def test_framed_files(spark, tmp_path):
    node = compile_text(TEXT)["m"]
    rows = [{"id": k, "name": f"name {k}"} for k in range(20)]
    for part in range(2):
        (tmp_path / f"{part}.bin").write_bytes(b"".join(framed.frame(encode_one(node, r)[0]) for r in rows[part::2]))
    (tmp_path / "empty.bin").write_bytes(b"")
    df = packed.decode(framed.read_framed(spark, str(tmp_path)), "payload", node)
    assert sorted(r["decoded"]["value"]["id"] for r in df.collect()) == list(range(20))
    with pytest.raises(ValueError, match="cut short"):
        list(framed.frames(framed.frame(b"abc")[:-1]))


def test_data_source(spark, tmp_path):
    spark.dataSource.register(framed.PackedFiles)
    options = {"schema_text": TEXT, "type": "m", "path": str(tmp_path / "out")}
    df = spark.createDataFrame([(k, f"n{k}") for k in range(9)], "id long, name string").repartition(3)
    df.write.format("packed").options(**options).mode("append").save()
    df.write.format("packed").options(**options).mode("overwrite").save()
    back = spark.read.format("packed").options(**options).load()
    assert sorted(map(tuple, back.collect())) == [(k, f"n{k}") for k in range(9)]
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith("_")]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, float) and v == v:
            return f"{v:.9g}"
        return "" if v is None or v is pd.NA or v is pd.NaT or v != v else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_against_oracle(spark, tables, name):
    ours, theirs = Q.QUERIES[name](spark, SF).toPandas(), tables.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
