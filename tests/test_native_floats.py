"""Float columns against the integer arithmetic of functions.floats."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitquarry.functions.floats import carrier, pack_floats, unpack_floats
from bitquarry.operators import native, packed
from bitquarry.schema import nodes as N

FORMATS = [(5, 10), (8, 7), (8, 23), (11, 52), (4, 3), (5, 2), (2, 1), (6, 9), (8, 0), (9, 30), (11, 24), (3, 28)]


def values(exponent: int, fraction: int) -> np.ndarray:
    rng = np.random.default_rng(exponent * 100 + fraction)
    bias = (1 << (exponent - 1)) - 1
    x = rng.normal(size=300) * np.exp2(rng.integers(-bias - fraction - 3, bias + 2, 300).astype(float))
    codes = rng.integers(0, 1 << 62, 300).astype(np.uint64) & np.uint64((1 << (1 + exponent + fraction)) - 1)
    own = unpack_floats(codes, exponent, fraction).astype(float)
    half = own[np.isfinite(own)] * (1 + 2.0 ** (-fraction - 1))
    edges = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, math.nan, 2.0**-149, 2.0**-1074, 2.0**-1022, 1.7e308, 65504.0, 65520.0, 3.4e38]
    return np.concatenate([x, own, half, edges])


@pytest.mark.parametrize("exponent,fraction", FORMATS)
def test_columns_equal_arrays(spark, exponent, fraction):
    node = N.Float(exponent, fraction)
    assert native.reads_natively(node)
    x = values(exponent, fraction)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x double")
    done = packed.encode(df, F.col("x"), node, "e", engine="native").collect()
    with np.errstate(over="ignore", invalid="ignore"):
        want = pack_floats(x, exponent, fraction)
    top = ((1 << exponent) - 1) << fraction
    size = -(-node.max_bits // 8)
    for r in done:
        code, v = int(want[r["k"]]), x[r["k"]]
        if np.isfinite(v) and code & ((1 << (exponent + fraction)) - 1) == top:
            assert r["e"]["error"] == "ErrorValueOverflow", v
        elif math.isnan(v):
            assert int.from_bytes(r["e"]["payload"], "big") >> (8 * size - node.max_bits) & top == top
        else:
            assert int.from_bytes(r["e"]["payload"], "big") >> (8 * size - node.max_bits) == code, v
    codes = sorted({int(c) for c in want})
    bits = [(c, (c << (8 * size - node.max_bits)).to_bytes(size, "big")) for c in codes]
    back = packed.decode(spark.createDataFrame([(k, b) for k, (_, b) in enumerate(bits)], "k int, p binary"), "p", node, engine="native").collect()
    kind = carrier(exponent, fraction)[0]
    for r in back:
        theirs = unpack_floats(np.array([bits[r["k"]][0]], np.uint64), exponent, fraction)[0]
        ours = r["decoded"]["value"]
        assert np.array_equal(kind(ours), theirs, equal_nan=True) and (math.copysign(1, ours) == math.copysign(1, theirs) or math.isnan(ours)), bits[r["k"]]


def test_short_and_null_floats(spark):
    node = N.obj(a=N.float_(5, 10), b=N.optional(N.float_(8, 23)))
    df = spark.createDataFrame([(1, b""), (2, b"\x3c\x00"), (3, b"\x3c\x00\x00"), (4, None)], "k int, p binary")
    got = {r["k"]: r["decoded"] for r in packed.decode(df, "p", node).collect()}
    assert [got[k]["error"] for k in (1, 2, 3)] == ["ErrorExpectedMoreBits", "ErrorExpectedMoreBits", None] and got[4] is None
    assert got[3]["value"].asDict() == {"a": 1.0, "b": None}
    empty = packed.encode(spark.createDataFrame([(None,)], "x double"), F.col("x"), N.float_(5, 10)).first()["encoded"]
    assert empty["error"] == "ErrorInvalidBitFieldValue"


def test_filters_stay_above_the_encoder(spark):
    node = N.obj(a=N.uint(32), b=N.vbr(False, 7, 7, 14), c=N.optional(N.uint(9)))
    df = spark.range(10).selectExpr("id as k", "named_struct('a', id, 'b', cast(id as int), 'c', cast(id as short)) as v")
    made = packed.encode(df, F.col("v"), node).select("k", F.col("encoded.payload").alias("p"))
    done = packed.decode(made, "p", node).where("decoded.value.c = 7 and k < 9").select("k", "decoded.value.b")
    assert [tuple(r) for r in done.collect()] == [(7, 7)]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter" in x]
    # The filter on k goes to the source; that on the decoded field is not rewritten.
    assert len(filters) == 2 and all(len(x) < 300 for x in filters) and "rand" not in plan


@pytest.mark.parametrize("exponent,fraction", [*FORMATS, (15, 20), (11, 2), (2, 29)])
def test_single_floats_equal_arrays(exponent, fraction):
    from bitquarry.functions.floats import pack_float, unpack_float

    with np.errstate(over="ignore", invalid="ignore"):
        x = values(exponent, fraction)
        codes = pack_floats(x, exponent, fraction)
        assert [pack_float(float(v), exponent, fraction) for v in x if not math.isnan(v)] == [int(c) for c, v in zip(codes, x) if not math.isnan(v)]
        back = unpack_floats(codes, exponent, fraction)
    for c, v in zip(codes, back):
        own = unpack_float(int(c), exponent, fraction)
        assert own == v or math.isnan(own) and math.isnan(v)
