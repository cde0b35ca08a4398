"""Ordered joins against brute force, late data, arms, optionals, text and sizes."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bitquarry.functions import columns as C
from bitquarry.functions.bits import BitSize
from bitquarry.operators import joins, packed
from bitquarry.schema import nodes as N
from bitquarry.sources import framed
from bitquarry.streaming import windows


def test_asof_join(spark):
    rng = random.Random(1)
    key = lambda: rng.choice([1, 1, 1, 1, 2, None])  # noqa: E731  a hot key
    place = lambda: rng.choice([None, *range(60)])
    left, right = ([(key(), place(), k) for k in range(n)] for n in (120, 60))
    got = joins.asof_join(spark.createDataFrame(left, "u int, t long, a int"), spark.createDataFrame(right, "u int, t long, b int"), "u", "t", 7)
    assert got.columns == ["u", "t", "a", "last_at", "last_b"]

    def want(u, t):
        met = [(x[1], x[2]) for x in right if x[0] == u and None not in (u, t, x[1]) and x[1] <= t]
        return max(met, default=(None, None))

    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame([(*x, *want(x[0], x[1])) for x in left], "u int, t long, a int, last_at long, last_b int").collect())
    empty = spark.createDataFrame([], "u int, t long, b int")
    assert joins.asof_join(spark.createDataFrame(left, "u int, t long, a int"), empty, "u", "t", 7).where("last_b is null").count() == 120
    assert joins.asof_join(empty, empty, "u", "t", 7).count() == 0


@pytest.mark.parametrize("by", [None, "u"])
def test_range_join(spark, by):
    rng = random.Random(2)
    points = [(rng.choice([1, 1, 2, None]), rng.choice([None, *range(-20, 40)]), k) for k in range(80)]
    ranges = [(rng.choice([1, 2, None]), a := rng.randrange(-20, 40), a + rng.randrange(-2, 15), k) for k in range(30)]
    p, r = spark.createDataFrame(points, "u int, at int, p int"), spark.createDataFrame(ranges, "u int, low int, high int, r int")
    got = joins.range_join(p, "at", r if by else r.drop("u"), "low", "high", 6, by)
    want = [(x[2], y[3]) for x in points for y in ranges if x[1] is not None and y[1] <= x[1] <= y[2] and (not by or x[0] == y[0] is not None)]
    assert sorted((x["p"], x["r"]) for x in got.collect()) == sorted(want)


def test_late_rows_are_dropped_and_batches_add_up(spark, tmp_path):
    node = N.obj(user=N.uint(20), cents=N.vbr(True, 8, 8, 16))
    rows = [[(0, 1, 100), (60, 1, 200), (86400 * 5, 2, 300)], [(86400 * 5 + 5, 2, 0)], [(30, 1, 999), (86400 * 5 + 10, 2, 50)], [(86400 * 20, 3, 1)], [(86400 * 20 + 1, 3, 1)]]
    for k, part in enumerate(rows):
        t = spark.createDataFrame(part, "at long, user int, cents int")
        t = packed.encode(t, F.struct("user", "cents"), node).select(F.timestamp_seconds("at").alias("ts"), F.col("encoded.payload").alias("payload"))
        t.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*"):
            if not f.name.startswith("part-done"):
                f.rename(f.with_name(f"part-done-{k}.parquet"))
    for k in range(len(rows)):
        os.utime(tmp_path / "in" / f"part-done-{k}.parquet", (1000 + k, 1000 + k))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windows.drained(windows.windowed(stream, "payload", node, "ts", "user", "cents", "1 hour", late="1 day"), mode="append")
    got = sorted((r["user"], r["n"], r["total"]) for r in out.collect())
    # The row of 999 came after the watermark had passed its window.
    assert got == [(1, 2, 300), (2, 3, 350)]


def test_arms_optionals_and_sizes(spark):
    node = N.variant(a=(1, N.uint(8)), b=(2, N.boolean()))
    df = spark.range(3).withColumn("v", C.make_arm(node, "a", F.col("id")))
    df = df.withColumn("w", C.set_arm(F.col("v"), node, "b", F.lit(True), when=F.col("id") == 1)).withColumn("none", C.make_arm(node, "null"))
    assert [(r["v"]["tag"], r["w"]["tag"], r["w"]["b"], r["none"]["tag"]) for r in df.orderBy("id").collect()] == [("a", "a", None, "null"), ("a", "b", True, "null"), ("a", "a", None, "null")]
    with pytest.raises(KeyError):
        C.make_arm(node, "c", F.lit(1))
    r = spark.createDataFrame([(5,), (None,)], "o int").select(C.try_get(F.col("o")).alias("g"), C.reset(F.col("o")).alias("r")).collect()
    assert [(x["g"]["value"], x["g"]["ok"], x["r"]) for x in r] == [(5, True, None), (None, False, None)]
    assert BitSize(13) + 4 - 1 == BitSize(16) and (BitSize(13) * 2).whole_bytes == 3 and BitSize(13).odd_bits == 5
    assert BitSize(3) < BitSize(4) <= BitSize(4) and BitSize(9) > 8
    with pytest.raises(ValueError):
        BitSize(3) - 4


@pytest.mark.parametrize("width,signed", [(64, False), (64, True), (8, True)])
def test_unchecked_arithmetic(spark, width, signed):
    node = N.Integer(width, signed)
    edge = [node.least, 0, 1, 3, node.most - 1, node.most, (1 << 40) + 7 if width == 64 else 7]
    pairs = [(Decimal(a), Decimal(b)) for a in edge for b in edge]
    df = spark.createDataFrame(pairs, "a decimal(20,0), b decimal(20,0)")
    for op in ("add", "sub", "mul"):
        for r in df.withColumn("r", C.unchecked(op, F.col("a"), F.col("b"), node)).collect():
            a, b = int(r["a"]), int(r["b"])
            x = {"add": a + b, "sub": a - b, "mul": a * b}[op] % (1 << 64)
            x -= (1 << 64) * (signed and x >> 63)
            assert (r["r"]["value"], r["r"]["error"]) == ((x, None) if node.least <= x <= node.most else (None, "ErrorValueOverflow")), (op, a, b)


def test_text_in_other_charsets(spark):
    r = spark.createDataFrame([("aé漢😀",), ("",), (None,)], "t string")
    for charset, python in (("UTF-8", "utf-8"), ("UTF-16BE", "utf-16-be"), ("UTF-16LE", "utf-16-le"), ("UTF-32", "utf-32-be")):
        got = [x["b"] if x["b"] is None else bytes(x["b"]) for x in r.select(C.encoded_text(F.col("t"), charset).alias("b")).collect()]
        assert got == ["aé漢😀".encode(python), b"", None], charset


def test_large_files_are_read_in_parts(tmp_path):
    node = N.obj(k=N.uint(32))
    w = framed._Writer(node, str(tmp_path), False, part_bytes=50)

    class Row(dict):
        def asDict(self, deep):
            return self

    w.commit([w.write(iter([Row(k=k) for k in range(40)]))])
    (name,) = [str(f) for f in tmp_path.glob("*.bin")]
    parts = framed.stretches(name)
    assert len(parts) > 4
    assert [N.decode_one(node, m)[0]["k"] for p in parts for m in framed.streamed(p, chunk=7)] == list(range(40))
    with open(name, "ab") as f:
        f.write(b"\0\0\0\x09ab")
    with pytest.raises(ValueError, match="cut short"):
        list(framed.streamed(framed.stretches(name)[-1]))
