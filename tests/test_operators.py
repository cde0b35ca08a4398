"""Native and Arrow engines against each other and against single messages."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitquarry.functions import columns as C
from bitquarry.operators import native, packed
from bitquarry.schema import nodes as N

MIXED = N.obj(
    a=N.uint(3),
    b=N.vbr(True, 5, 9, 20),
    c=N.optional(N.obj(x=N.sint(33), y=N.uint(64))),
    d=N.array(N.uint(11), 6, 1, "prefixed"),
    e=N.buffer(5, 3, signed=True),
    f=N.enum("x", "y", "z", least=4),
    g=N.variant(p=(1, N.uint(7)), q=(4, N.obj(r=N.boolean(), s=N.vbr(False, 3, 3)))),
    h=N.buffer(4, 2, 2),
    i=N.sint(64),
)


def value(rng: random.Random) -> dict:
    number = lambda n, s: rng.randint(-(1 << (n - 1)), (1 << (n - 1)) - 1) if s else rng.randint(0, (1 << n) - 1)
    g = rng.choice([None, "p", "q"])
    return {
        "a": number(3, False),
        "b": number(rng.choice([4, 12, 34]), True),
        "c": rng.choice([None, {"x": number(33, True), "y": Decimal(number(64, False))}]),
        "d": [number(11, False) for _ in range(rng.randint(1, 6))],
        "e": [number(5, True) for _ in range(rng.randint(0, 3))],
        "f": rng.choice("xyz"),
        "g": {"tag": g or "null", "p": number(7, False) if g == "p" else None, "q": {"r": rng.random() < 0.5, "s": number(rng.choice([3, 6]), False)} if g == "q" else None},
        "h": [number(4, False), number(4, False)],
        "i": number(64, True),
    }


def test_native_equals_arrow_and_single(spark):
    assert native.reads_natively(MIXED)
    rng = random.Random(3)
    values = [value(rng) for _ in range(60)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", MIXED.spark_type())])).repartition(2)
    both = packed.encode(packed.encode(df, F.col("v"), MIXED, "n", engine="native"), F.col("v"), MIXED, "a", engine="arrow")
    rows = {r["k"]: r for r in both.collect()}
    for k, v in enumerate(values):
        data, bits = N.encode_one(MIXED, v)
        for engine in "na":
            assert (bytes(rows[k][engine]["payload"]), rows[k][engine]["bit_len"], rows[k][engine]["error"]) == (data, bits, None), (k, engine)
        assert bits == MIXED.bits(v)
    payloads = spark.createDataFrame([(k, N.encode_one(MIXED, v)[0]) for k, v in enumerate(values)], "k int, p binary")
    back = packed.decode(packed.decode(payloads, "p", MIXED, "n", engine="native"), "p", MIXED, "a", engine="arrow")
    for r in back.collect():
        assert r["n"]["value"].asDict(True) == r["a"]["value"].asDict(True) == values[r["k"]]
        assert r["n"]["bits_read"] == r["a"]["bits_read"] == MIXED.bits(values[r["k"]])


def test_truncated_and_damaged_payloads(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        data = bytearray(N.encode_one(MIXED, value(rng))[0])
        rows.append((k, bytes(data[: rng.randint(0, len(data))])))
        data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        rows.append((100 + k, bytes(data)))
    rows.append((1000, None))
    both = packed.decode(packed.decode(spark.createDataFrame(rows, "k int, p binary"), "p", MIXED, "n", engine="native"), "p", MIXED, "a", engine="arrow")
    for r in both.collect():
        n, a = r["n"], r["a"]
        if r["k"] == 1000:
            assert n is None and a is None
            continue
        warned = a["error"] == "WarningNotSupportedConfiguration"
        assert n["error"] == (None if warned else a["error"])
        assert n["value"] == a["value"]


def test_modes_and_bounds(spark):
    node = N.uint(12)
    df = spark.createDataFrame([(1, b"\x01\x20"), (2, b"\x01")], "k int, p binary")
    assert [r["k"] for r in packed.decode(df, "p", node, mode="DROPMALFORMED").collect()] == [1]
    with pytest.raises(Exception, match="malformed message"):
        packed.decode(df, "p", node, mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        packed.decode(df, "p", node, mode="OTHER")
    assert packed.decode(df.where("k = 1").withColumn("n", F.lit(11)), "p", node, bit_len="n").first()["decoded"]["error"] == "ErrorExpectedMoreBits"
    assert packed.decode(df.where("k = 1"), "p", N.uint(5), start_bit=7).first()["decoded"]["value"] == 18
    values = spark.createDataFrame([(5,), (5000,), (None,)], "v int")
    assert [r["encoded"]["error"] for r in packed.encode(values, F.col("v"), node).collect()] == [None, "ErrorValueOverflow", "ErrorInvalidBitFieldValue"]
    assert packed.encode(values, F.col("v"), node, max_bytes=1).first()["encoded"]["error"] == "ErrorInsufficentBufferSize"
    assert [r["code"] for r in packed.validate(values, F.col("v"), node).collect()] == ["Ok", "ErrorValueOverflow", "ErrorInvalidBitFieldValue"]
    names = spark.createDataFrame([("abc",), ("x" * 50,), (None,)], "v string")
    assert [r["code"] for r in packed.validate(names, F.col("v"), N.text(20)).collect()] == ["Ok", "ErrorValueOverflow", "ErrorInvalidBitFieldValue"]
    assert [r["bits"] for r in packed.bit_size(names, F.col("v"), N.text(128)).collect()] == [23, 258, None]


def test_empty_frames(spark):
    df = spark.createDataFrame([], "p binary")
    for node in (N.uint(5), MIXED, N.text(9)):
        assert packed.decode(df, "p", node).count() == 0


def test_plans_are_narrow_and_pruned(spark):
    node = N.obj(a=N.uint(32), b=N.uint(4), c=N.sint(16))
    df = spark.range(10).select(F.lit(b"\0" * 7).alias("p"), "id").repartition(2)
    plan = packed.select_fields(df, "p", node, "b").where("b = 0").select("b")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = packed.decode(df, "p", MIXED).select("decoded.value.a")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_messages_back_to_back(spark):
    from bitquarry.functions.bits import BitWriter

    node = N.obj(k=N.uint(5), t=N.text(20))
    w = BitWriter()
    values = [{"k": k, "t": "ab" * k} for k in range(4)]
    for v in values:
        node.write(w, v)
    df = spark.createDataFrame([(w.to_bytes(), 4), (b"", 0), (None, 1)], "p binary, n int")
    rows = packed.explode_messages(df, "p", node, count="n").collect()
    assert [r["message"]["value"].asDict() for r in rows] == values
    short = packed.explode_messages(spark.createDataFrame([(w.to_bytes()[:-3], 4)], "p binary, n int"), "p", node, count="n").collect()
    assert short[-1]["message"]["error"] == "ErrorExpectedMoreBits"


@pytest.mark.parametrize("width,signed", [(4, False), (4, True), (8, True), (64, False), (64, True)])
def test_checked_arithmetic(spark, width, signed):
    node = N.Integer(width, signed)
    edge = [node.least, node.least + 1, 0, 1, 2, 3, node.most // 2, node.most - 1, node.most] + ([-1, -2, -3] if signed else [])
    kind = "decimal(20,0)" if width == 64 else "long"
    pairs = [(Decimal(a), Decimal(b)) if width == 64 else (a, b) for a in edge for b in edge]
    df = spark.createDataFrame(pairs, f"a {kind}, b {kind}")
    for op in ("add", "sub", "mul", "div"):
        for r in df.withColumn("r", C.checked(op, F.col("a"), F.col("b"), node)).collect():
            a, b = int(r["a"]), int(r["b"])
            if op == "div" and b == 0:
                expected = None, "ErrorInvalidBitFieldValue"
            else:
                x = {"add": a + b, "sub": a - b, "mul": a * b}.get(op)
                if x is None:
                    x = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
                expected = (x, None) if node.least <= x <= node.most else (None, "ErrorValueOverflow")
            assert (r["r"]["value"], r["r"]["error"]) == expected, (op, a, b)


def test_column_functions(spark):
    df = spark.createDataFrame([(1.0, [1, 2, 3], None), (float("nan"), [1], 5)], "x double, v array<int>, o int")
    r = df.select(C.equal_floats(F.col("x"), F.col("x")).alias("e"), C.fixed_slice(F.col("v"), 2, F.lit(0)).alias("s"), C.unwrap(F.col("o"))["error"].alias("u"), C.value_or(F.col("o"), F.lit(9)).alias("w")).collect()
    assert [tuple(x) for x in r] == [(True, [1, 2], "ErrorOptionalValueIsEmpty", 9), (False, [1, 0], None, 5)]
    with pytest.raises(Exception, match="ErrorValueOverflow"):
        df.select(C.checked_or_raise("add", F.lit(9), F.lit(9), N.uint(4))).collect()
    assert df.select(C.quantize_float(F.lit(3.14159265359), 5, 10).alias("q")).first()["q"] == 3.140625
