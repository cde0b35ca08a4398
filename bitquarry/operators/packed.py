"""Encode, decode, validate and measure columns of packed messages.

Each operator is map-side.  Schemas that expressions can express stay in the
JVM; the others (floats, five-bit text, arrays of varying elements) go through
one Arrow map.  Errors are data: ``PERMISSIVE`` keeps them, ``DROPMALFORMED``
drops their rows, ``FAILFAST`` raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bitquarry.functions.bits import CodecError
from bitquarry.operators import native
from bitquarry.schema.nodes import Boolean, Float, Integer, Node, Object, decode_one, encode_one

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def _arrow_map(df: DataFrame, column: Column, out: str, kind: T.DataType, one) -> DataFrame:
    """df with out = one(value of column), by an Arrow function on batches."""
    target = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in values:
            yield pa.array([one(x) for x in v.to_pylist()], type=target)

    return df.withColumn(out, run(column))


def _by_mode(df: DataFrame, out: str, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    c = F.col(out)
    if mode == "DROPMALFORMED":
        return df.where(c["error"].isNull())
    if mode == "FAILFAST":
        return df.withColumn(out, F.when(c["error"].isNull(), c).otherwise(F.raise_error(F.concat(F.lit("malformed message: "), c["error"])).cast(df.schema[out].dataType)))
    return df


def decode(df: DataFrame, payload: str, node: Node, out: str = "decoded", mode: str = "PERMISSIVE", bit_len: str | None = None, start_bit: int = 0, engine: str = "auto") -> DataFrame:
    """df with out: struct<value, error, bits_read>; a null payload gives null.

    bit_len names a column of meaningful bits; engine is auto, native or arrow.
    An unknown variant tag or a clamped text length gives the value and a warning as error.
    """
    if engine == "native" or engine == "auto" and native.reads_natively(node):
        return _by_mode(native.decode(df, payload, node, out, bit_len, start_bit), out, mode)
    kind = T.StructType([T.StructField("value", node.spark_type()), T.StructField("error", T.StringType()), T.StructField("error_field", T.StringType()), T.StructField("bits_read", T.LongType())])

    def one(x):
        if x is None or x["p"] is None:
            return None
        try:
            value, end, warning = decode_one(node, x["p"], x["n"], start_bit)
        except CodecError as e:
            return {"error": e.code, "error_field": e.field}
        return {"value": value, "error": warning, "bits_read": end - start_bit}

    n = F.col(bit_len).cast("int") if bit_len else F.lit(None).cast("int")
    return _by_mode(_arrow_map(df, F.struct(F.col(payload).alias("p"), n.alias("n")), out, kind, one), out, mode)


def encode(df: DataFrame, value: Column, node: Node, out: str = "encoded", mode: str = "PERMISSIVE", max_bytes: int | None = None, engine: str = "auto") -> DataFrame:
    """df with out: struct<payload, bit_len, error>; max_bytes bounds the message."""
    if engine == "native" or engine == "auto" and native.reads_natively(node):
        done = native.encode(df, value, node, out)
        if max_bytes is not None:
            over = F.octet_length(F.col(out)["payload"]) > max_bytes
            done = done.withColumn(out, F.when(over, F.struct(F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("long").alias("bit_len"), F.lit("ErrorInsufficentBufferSize").alias("error"))).otherwise(F.col(out)))
        return _by_mode(done, out, mode)
    kind = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("bit_len", T.LongType()), T.StructField("error", T.StringType())])

    def one(x):
        try:
            data, bits = encode_one(node, x, max_bytes)
        except CodecError as e:
            return {"error": e.code}
        return {"payload": data, "bit_len": bits}

    return _by_mode(_arrow_map(df, value, out, kind, one), out, mode)


def bit_size(df: DataFrame, value: Column, node: Node, out: str = "bits") -> DataFrame:
    """df with the exact size of each value; null where it can't be written."""

    def one(x):
        try:
            node.check(x)
            return node.bits(x)
        except CodecError:
            return None

    if native.reads_natively(node):
        return native.encode(df, value, node, "__encoded").withColumn(out, F.col("__encoded")["bit_len"]).drop("__encoded")
    return _arrow_map(df, value, out, T.LongType(), one)


def validate(df: DataFrame, value: Column, node: Node, out: str = "code") -> DataFrame:
    """df with the result code of storing each value."""

    def one(x):
        try:
            node.check(x)
            return "Ok"
        except CodecError as e:
            return e.code

    if native.reads_natively(node):
        return native.encode(df, value, node, "__encoded").withColumn(out, F.coalesce(F.col("__encoded")["error"], F.lit("Ok"))).drop("__encoded")
    return _arrow_map(df, value, out, T.StringType(), one)


def field_at(node: Object, path: str) -> tuple[int, Node]:
    """(bit offset, node) of a field at a fixed offset, by its dotted path."""
    at = 0
    for name in path.split("."):
        for k, n in node.fields:
            if k == name:
                node = n
                break
            if n.min_bits != n.max_bits:
                raise ValueError(f"{path} has no fixed offset")
            at += n.max_bits
        else:
            raise KeyError(path)
    return at, node


def select_fields(df: DataFrame, payload: str, node: Object, *paths: str) -> DataFrame:
    """df with a column for each path, decoding only these fields; null where the payload is too short."""
    for path in paths:
        at, n = field_at(node, path)
        df = decode(df, payload, n, "__field", start_bit=at).withColumn(path.split(".")[-1], F.col("__field")["value"]).drop("__field")
    return df


def _plain(node: Node) -> bool:
    """Whether all bits of a message of the node's size are values."""
    return isinstance(node, Boolean | Integer) or isinstance(node, Float) and native.reads_natively(node) or isinstance(node, Object) and bool(node.fields) and all(_plain(n) for _, n in node.fields)


def explode_messages(df: DataFrame, payload: str, node: Node, out: str = "message", count: str | None = None, least_bits: int | None = None) -> DataFrame:
    """A row for each of several messages that stand back to back in a payload, at bit granularity.

    Columns ``message_no``, out (struct<value, error, bits_read>).  count names a
    column with their number; without it reading ends when fewer bits are left
    than the smallest message has (a byte at least, so that the fill is none).
    An error ends the payload.
    """
    size, least = node.max_bits, least_bits or max(8, node.min_bits)
    if size == node.min_bits and _plain(node):
        # Each message's place follows from its number: no Python.
        bits = F.octet_length(payload) * 8
        n = F.least(F.col(count).cast("int"), (bits / size).cast("int") + 1) if count else F.when(bits >= least, ((bits - least) / size).cast("int") + 1)
        rows = df.withColumn("message_no", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
        return native.decode(rows, payload, node, out, start=F.col("message_no") * size)
    item = T.StructType([T.StructField("message_no", T.IntegerType()), T.StructField("value", node.spark_type()), T.StructField("error", T.StringType()), T.StructField("bits_read", T.LongType())])

    def one(x):
        out, at = [], 0
        while x["p"] is not None and (len(out) < x["n"] if x["n"] is not None else 8 * len(x["p"]) - at >= least):
            try:
                value, end, warning = decode_one(node, x["p"], None, at)
            except CodecError as e:
                out.append({"message_no": len(out), "error": e.code})
                break
            out.append({"message_no": len(out), "value": value, "error": warning, "bits_read": end - at})
            at = end
        return out

    n = F.col(count).cast("int") if count else F.lit(None).cast("int")
    listed = _arrow_map(df, F.struct(F.col(payload).alias("p"), n.alias("n")), "__all", T.ArrayType(item), one)
    rows = listed.withColumn("__one", F.explode("__all")).drop("__all")
    c = F.col("__one")
    return rows.withColumn("message_no", c["message_no"]).withColumn(out, F.struct(c["value"].alias("value"), c["error"].alias("error"), c["bits_read"].alias("bits_read"))).drop("__one")
