"""Column functions: zig-zag, variable-bit-rate sizes, checked arithmetic, quantisation, sizes."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitquarry.functions.floats import carrier, quantized
from bitquarry.operators.native import _code, vbr_groups, zigzag_decode, zigzag_encode
from bitquarry.schema.nodes import Integer, Variant, Vbr

__all__ = [
    "checked", "checked_or_raise", "encoded_text", "equal_by_value", "equal_floats", "fixed_slice", "get_arm", "growable_bytes", "is_arm", "make_arm", "quantize_float", "reset", "set_arm", "try_get", "unchecked", "unwrap", "value_or", "vbr_bits", "zigzag_decode", "zigzag_encode",
]


def vbr_bits(value: Column, node: Vbr) -> Column:
    """The exact bits of a value; null outside the domain."""
    code, outside = _code(node.whole, value)
    k = vbr_groups(code, node)
    sizes = F.array(*(F.lit(node.group_bits(g)) for g in range(1, len(node.segments) + 1)))
    return F.when(~outside, F.element_at(sizes, k))


def checked(op: str, a: Column, b: Column, node: Integer | Vbr) -> Column:
    """struct<value, error> of add, sub, mul or div (towards zero) within the node's domain.

    Computed wide, so there is no wrap-around; null operands give nulls.
    """
    n = node.whole if isinstance(node, Vbr) else node
    wide = lambda c: c.cast("decimal(20,0)")
    a, b = wide(a), wide(b)
    low, high = (F.lit(Decimal(x)).cast("decimal(20,0)") for x in (n.least, n.most))
    zero = F.lit(False)
    if op == "add":
        raw = a + b
    elif op == "sub":
        raw = a - b
    elif op == "mul":
        raw = F.try_multiply(a, b)
    elif op == "div":
        zero = b == 0
        # Whole numbers of up to 20 digits: the quotient is cut, not rounded.
        raw = F.call_function("div", a, F.when(~zero, b)) if n.width < 64 else F.when(~zero, _cut(a, b))
    else:
        raise ValueError(f"unknown operation {op}")
    inside = raw.isNotNull() & raw.between(low, high)
    known = a.isNotNull() & b.isNotNull()
    error = F.when(known & zero, "ErrorInvalidBitFieldValue").when(known & ~inside, "ErrorValueOverflow")
    return F.struct(F.when(known & inside & ~zero, raw).cast(node.spark_type()).alias("value"), error.alias("error"))


def _cut(a: Column, b: Column) -> Column:
    quotient = (F.abs(a) - F.abs(a) % F.abs(b)) / F.abs(b)
    return (F.signum(a).cast("decimal(20,0)") * F.signum(b).cast("decimal(20,0)") * F.round(quotient).cast("decimal(20,0)")).cast("decimal(38,0)")


_WORD = Decimal(1 << 64)


def unchecked(op: str, a: Column, b: Column, node: Integer | Vbr) -> Column:
    """struct<value, error> of add, sub or mul as 64-bit words give it, then the node's range check.

    Sums and products wrap around at 64 bits, so for narrow nodes this differs
    from checked() only where the word itself overflows.
    """
    n = node.whole if isinstance(node, Vbr) else node
    word = lambda c: F.pmod(c.cast("decimal(38,0)"), F.lit(_WORD).cast("decimal(38,0)")).cast("decimal(38,0)")
    x, y = word(a), word(b)
    if op == "add":
        raw = x + y
    elif op == "sub":
        raw = x - y + F.lit(_WORD)
    elif op == "mul":
        # Of two halves of y, so that no product leaves 38 digits.
        half = F.lit(Decimal(1 << 32)).cast("decimal(38,0)")
        low = F.pmod(y, half)
        high = ((y - low) / half).cast("decimal(11,0)")
        x = x.cast("decimal(20,0)")
        raw = F.pmod((x * high).cast("decimal(38,0)"), half).cast("decimal(11,0)") * Decimal(1 << 32) + (x * low.cast("decimal(11,0)")).cast("decimal(38,0)")
    else:
        raise ValueError(f"unknown operation {op}")
    raw = word(raw)
    if n.signed:
        raw = F.when(raw >= F.lit(Decimal(1 << 63)), raw - F.lit(_WORD)).otherwise(raw)
    known = a.isNotNull() & b.isNotNull()
    inside = raw.between(F.lit(Decimal(n.least)), F.lit(Decimal(n.most)))
    return F.struct(F.when(known & inside, raw).cast(node.spark_type()).alias("value"), F.when(known & ~inside, "ErrorValueOverflow").alias("error"))


def checked_or_raise(op: str, a: Column, b: Column, node: Integer | Vbr) -> Column:
    """The value of checked(); an error fails the query."""
    r = checked(op, a, b, node)
    return F.when(r["error"].isNull(), r["value"]).otherwise(F.raise_error(r["error"]).cast(node.spark_type()))


def quantize_float(c: Column, exponent: int, fraction: int) -> Column:
    """Values as they come back from a float of these widths."""
    kind = "float" if carrier(exponent, fraction)[0] is np.float32 else "double"

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(quantized(x.to_numpy(np.float64), exponent, fraction)).where(x.notna(), None)

    return run(c.cast("double"))


def equal_by_value(a: Column, b: Column) -> Column:
    """Equality of field values: two nulls are equal."""
    return a.eqNullSafe(b)


def equal_floats(a: Column, b: Column) -> Column:
    """The same for floats, where NaN differs from itself."""
    return a.eqNullSafe(b) & ~F.coalesce(F.isnan(a), F.lit(False))


def unwrap(c: Column) -> Column:
    """struct<value, error> of an optional that must be there."""
    return F.struct(c.alias("value"), F.when(c.isNull(), "ErrorOptionalValueIsEmpty").alias("error"))


def value_or(c: Column, default: Column) -> Column:
    return F.coalesce(c, default)


def try_get(c: Column) -> Column:
    """struct<value, ok> of an optional."""
    return F.struct(c.alias("value"), c.isNotNull().alias("ok"))


def reset(c: Column) -> Column:
    """The optional without its value, of the same type."""
    return F.when(F.lit(False), c)


def make_arm(node: Variant, name: str, value: Column | None = None) -> Column:
    """A variant with one arm set; name "null" sets none."""
    if name != "null" and name not in {k for k, *_ in node.arms}:
        raise KeyError(name)
    parts = [(value if k == name else F.lit(None)).cast(n.spark_type()).alias(k) for k, _, n in node.arms]
    return F.struct(F.lit(name).alias("tag"), *parts)


def set_arm(variant: Column, node: Variant, name: str, value: Column, when: Column | None = None) -> Column:
    """The variant with another arm in place of its own, where ``when`` holds (everywhere without it)."""
    made = make_arm(node, name, value)
    return made if when is None else F.when(when, made).otherwise(variant)


def growable_bytes(min_bits: Column, max_bits: Column, percent: Column) -> Column:
    """Bytes to reserve for a growing buffer: a share (0 to 100 percent) of the range above the smallest message."""
    low, high = (F.call_function("div", x + 7, F.lit(8)) for x in (min_bits, max_bits))
    return low + F.call_function("div", (high - low) * F.least(F.greatest(percent, F.lit(0)), F.lit(100)), F.lit(100))


def encoded_text(c: Column, charset: str) -> Column:
    """Text as UTF-8, UTF-16BE, UTF-16LE or UTF-32 bytes; the last by code point, without a mark of byte order."""
    if charset not in ("UTF-8", "UTF-16BE", "UTF-16LE", "UTF-32"):
        raise ValueError(f"unknown charset {charset}")
    if charset != "UTF-32":
        return F.encode(c, charset)
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.lpad(F.hex(F.ascii(x)), 8, "0"))
    return F.unhex(F.array_join(points, ""))


def is_arm(variant: Column, name: str) -> Column:
    return F.coalesce(variant["tag"] == name, F.lit(False))


def get_arm(variant: Column, name: str) -> Column:
    """The arm's value; null where another arm is set."""
    return F.when(variant["tag"] == name, variant[name])


def fixed_slice(c: Column, n: int, fill: Column) -> Column:
    """An array as exactly n elements: cut, or filled at the end."""
    return F.concat(F.slice(c, 1, n), F.array_repeat(fill, F.greatest(F.lit(n) - F.size(c), F.lit(0))))
