"""Codec nodes: one immutable tree is the source of types, sizes and codecs.

``write`` and ``read`` work on one message.  ``operators.native`` compiles the
nodes that expressions can express into Spark columns; ``operators.packed``
chooses.  Values are what Spark rows hold: None for null, dicts for objects and
variants, lists for arrays, labels for enumerations that have them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import types as T

from bitquarry.functions import text as five_bit
from bitquarry.functions.bits import BitReader, BitWriter, CodecError, unzigzag, width_of, zigzag
from bitquarry.functions.floats import carrier, pack_float, unpack_float


def _int_type(bits: int, signed: bool) -> T.DataType:
    for most, kind in ((8, T.ByteType()), (16, T.ShortType()), (32, T.IntegerType()), (64, T.LongType())):
        if bits + (not signed) <= most:
            return kind
    return T.DecimalType(20, 0)


@dataclass(frozen=True)
class Node:
    """A field type.  Subclasses give min_bits, max_bits, spark_type, bits, write and read."""

    def default(self):
        return None

    def check(self, value) -> None:
        """Raise the error that storing the value gives, if any."""
        self.write(BitWriter(), value)

    def bits(self, value) -> int:
        """The exact size of a value."""
        return self.max_bits

    @property
    def max_bytes(self) -> int:
        """Of a buffer that holds any value."""
        return -(-self.max_bits // 8)


@dataclass(frozen=True)
class Null(Node):
    """Nothing; legal only as a variant's arm 0."""

    min_bits = max_bits = 0

    def spark_type(self):
        return T.NullType()

    def write(self, w, value):
        raise CodecError("ErrorCanNotWriteNullValue")

    def read(self, r):
        raise CodecError("ErrorCanNotReadNullValue")


@dataclass(frozen=True)
class Boolean(Node):
    min_bits = max_bits = 1

    def spark_type(self):
        return T.BooleanType()

    def default(self):
        return False

    def write(self, w, value):
        w.put(bool(value), 1)

    def read(self, r):
        return bool(r.get(1))


@dataclass(frozen=True)
class Integer(Node):
    """Of a fixed number of bits; signed values are in zig-zag order."""

    width: int
    signed: bool = False

    def __post_init__(self):
        if not 1 <= self.width <= 64:
            raise ValueError("an integer has 1 to 64 bits")

    min_bits = max_bits = property(lambda self: self.width)

    @property
    def least(self) -> int:
        return -(1 << (self.width - 1)) if self.signed else 0

    @property
    def most(self) -> int:
        return (1 << (self.width - self.signed)) - 1

    def spark_type(self):
        return _int_type(self.width, self.signed)

    def default(self):
        return 0

    def code(self, value) -> int:
        if value is None:
            raise CodecError("ErrorInvalidBitFieldValue")
        value = int(value)
        if not self.least <= value <= self.most:
            raise CodecError("ErrorValueOverflow")
        return zigzag(value) if self.signed else value

    def value(self, code: int):
        if self.signed:
            return unzigzag(code)
        return Decimal(code) if self.width == 64 else code

    def write(self, w, value):
        w.put(self.code(value), self.width)

    def read(self, r):
        return self.value(r.get(self.width))


@dataclass(frozen=True)
class Vbr(Node):
    """An integer in as few leading segments as hold it, each but the last possible one after a continuation bit."""

    signed: bool
    segments: tuple[int, ...]

    def __post_init__(self):
        if len(self.segments) < 2 or min(self.segments) < 1 or sum(self.segments) > 64:
            raise ValueError("two or more segments of at least one bit, 64 in all")

    @property
    def whole(self) -> Integer:
        return Integer(sum(self.segments), self.signed)

    @property
    def min_bits(self) -> int:
        return self.segments[0] + 1

    @property
    def max_bits(self) -> int:
        return sum(self.segments) + len(self.segments) - 1

    def spark_type(self):
        return self.whole.spark_type()

    def default(self):
        return 0

    def groups(self, code: int) -> int:
        return next((k for k in range(1, len(self.segments)) if code >> sum(self.segments[:k]) == 0), len(self.segments))

    def group_bits(self, k: int) -> int:
        return sum(self.segments[:k]) + min(k, len(self.segments) - 1)

    def bits(self, value):
        return self.group_bits(self.groups(self.whole.code(value)))

    def write(self, w, value):
        code = self.whole.code(value)
        k = self.groups(code)
        left = sum(self.segments[:k])
        for g, n in enumerate(self.segments[:k]):
            left -= n
            if g < len(self.segments) - 1:
                w.put(g + 1 < k, 1)
            w.put(code >> left, n)

    def read(self, r):
        code = 0
        for g, n in enumerate(self.segments):
            more = g < len(self.segments) - 1 and r.get(1)
            code = code << n | r.get(n)
            if not more:
                break
        return self.whole.value(code)


@dataclass(frozen=True)
class Float(Node):
    """A float of any exponent and fraction width; infinities are values, finite values beyond the range are not."""

    exponent: int
    fraction: int

    def __post_init__(self):
        if self.exponent < 2 or self.fraction < 0 or 1 + self.exponent + self.fraction > 64:
            raise ValueError("at least two exponent bits, 64 bits in all")

    min_bits = max_bits = property(lambda self: 1 + self.exponent + self.fraction)

    def spark_type(self):
        return T.FloatType() if carrier(self.exponent, self.fraction)[0] is np.float32 else T.DoubleType()

    def default(self):
        return 0.0

    def write(self, w, value):
        if value is None:
            raise CodecError("ErrorInvalidBitFieldValue")
        code = pack_float(value, self.exponent, self.fraction)
        top = ((1 << self.exponent) - 1) << self.fraction
        if math.isfinite(value) and code & ((1 << (self.exponent + self.fraction)) - 1) == top:
            raise CodecError("ErrorValueOverflow")
        w.put(code, self.max_bits)

    def read(self, r):
        return unpack_float(r.get(self.max_bits), self.exponent, self.fraction)


@dataclass(frozen=True)
class Enumeration(Node):
    """The dense codes least to most; labels, if given, are for least and up."""

    least: int
    most: int
    labels: tuple[str, ...] = ()

    @property
    def min_bits(self) -> int:
        return width_of(self.most - self.least)

    max_bits = min_bits

    def spark_type(self):
        return T.StringType() if self.labels else T.IntegerType()

    def default(self):
        return self.labels[0] if self.labels else self.least

    def write(self, w, value):
        if self.labels:
            if value not in self.labels:
                raise CodecError("ErrorValueOverflow")
            value = self.least + self.labels.index(value)
        if value is None or not self.least <= value <= self.most:
            raise CodecError("ErrorValueOverflow")
        w.put(value - self.least, self.max_bits)

    def read(self, r):
        code = r.get(self.max_bits)
        if code > self.most - self.least:
            raise CodecError("ErrorValueOverflow")
        return self.labels[code] if self.labels else self.least + code


@dataclass(frozen=True)
class Optional(Node):
    type: Node

    min_bits = 1

    @property
    def max_bits(self) -> int:
        return 1 + self.type.max_bits

    def spark_type(self):
        return self.type.spark_type()

    def bits(self, value):
        return 1 if value is None else 1 + self.type.bits(value)

    def write(self, w, value):
        w.put(value is not None, 1)
        if value is not None:
            self.type.write(w, value)

    def read(self, r):
        return self.type.read(r) if r.get(1) else None


@dataclass(frozen=True)
class Array(Node):
    """min_elements to max_elements; shorter input is filled with defaults, which come back as elements."""

    type: Node
    min_elements: int
    max_elements: int
    encoding: str = "three_plus_prefixed"

    def __post_init__(self):
        if not 0 <= self.min_elements <= self.max_elements or self.max_elements < 1:
            raise ValueError("0 <= min_elements <= max_elements, and at least one element")
        if self.encoding not in ("three_plus_prefixed", "delimited", "prefixed"):
            raise ValueError(f"unknown encoding {self.encoding}")
        if self.encoding == "delimited" and self.fixed:
            raise ValueError("a delimited array needs max_elements over min_elements: its reader expects an end bit that a full one lacks")

    @property
    def fixed(self) -> bool:
        return self.min_elements == self.max_elements

    @property
    def delimited(self) -> bool:
        return self.encoding == "delimited" or self.encoding == "three_plus_prefixed" and 0 < self.max_elements - self.min_elements <= 3

    @property
    def prefix(self) -> int:
        return 0 if self.fixed or self.delimited else width_of(self.max_elements - self.min_elements)

    def _size(self, n: int, elements: int) -> int:
        if self.delimited:
            return elements + n - self.min_elements + (n < self.max_elements)
        return self.prefix + elements

    @property
    def min_bits(self) -> int:
        return self._size(self.min_elements, self.min_elements * self.type.min_bits)

    @property
    def max_bits(self) -> int:
        return self._size(self.max_elements, self.max_elements * self.type.max_bits)

    def spark_type(self):
        return T.ArrayType(self.type.spark_type(), isinstance(self.type, Optional))

    def default(self):
        return []

    def _filled(self, value) -> list:
        value = list(value or [])
        if len(value) > self.max_elements:
            raise CodecError("ErrorTooManyElements")
        return value + [self.type.default()] * (self.min_elements - len(value))

    def bits(self, value):
        v = self._filled(value)
        return self._size(len(v), sum(map(self.type.bits, v)))

    def write(self, w, value):
        v = self._filled(value)
        w.put(len(v) - self.min_elements, self.prefix)
        for k, x in enumerate(v):
            if self.delimited and k >= self.min_elements:
                w.put(1, 1)
            self.type.write(w, x)
        if self.delimited and len(v) < self.max_elements:
            w.put(0, 1)

    def read(self, r):
        n = self.min_elements + r.get(self.prefix)
        if n > self.max_elements:
            raise CodecError("ErrorTooManyElements")
        out = [self.type.read(r) for _ in range(n)]
        while self.delimited and len(out) < self.max_elements and r.get(1):
            out.append(self.type.read(r))
        return out


@dataclass(frozen=True)
class Object(Node):
    fields: tuple[tuple[str, Node], ...]

    @property
    def min_bits(self) -> int:
        return sum(n.min_bits for _, n in self.fields)

    @property
    def max_bits(self) -> int:
        return sum(n.max_bits for _, n in self.fields)

    def spark_type(self):
        return T.StructType([T.StructField(k, n.spark_type()) for k, n in self.fields])

    def default(self):
        return {k: n.default() for k, n in self.fields}

    def bits(self, value):
        return sum(n.bits(value[k]) for k, n in self.fields)

    def _each(self, do):
        for k, n in self.fields:
            try:
                do(k, n)
            except CodecError as e:
                raise CodecError(e.code, f"{k}.{e.field}" if e.field else k) from None

    def write(self, w, value):
        if value is None:
            raise CodecError("ErrorInvalidBitFieldValue")
        self._each(lambda k, n: n.write(w, value[k]))

    def read(self, r):
        out = {}
        self._each(lambda k, n: out.update({k: n.read(r)}))
        return out


@dataclass(frozen=True)
class Variant(Node):
    """One of several arms; arm 0 is null.  Values are {"tag": name, name: value}; tag "null" for null."""

    options: tuple[tuple[str, int, Node], ...]

    def __post_init__(self):
        ids = [i for _, i, _ in self.options]
        if not ids or min(ids) < 0 or len(set(ids)) < len(ids) or any(i == 0 and not isinstance(n, Null) for _, i, n in self.options) or any(i and isinstance(n, Null) for _, i, n in self.options):
            raise ValueError("arms need ids of their own; 0 is for null alone")

    @property
    def arms(self) -> list[tuple[str, int, Node]]:
        return [x for x in self.options if x[1]]

    @property
    def tag_bits(self) -> int:
        return width_of(max(i for _, i, _ in self.options))

    min_bits = property(lambda self: self.tag_bits)

    @property
    def max_bits(self) -> int:
        return self.tag_bits + max((n.max_bits for *_, n in self.arms), default=0)

    def spark_type(self):
        return T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(k, n.spark_type()) for k, _, n in self.arms)])

    def default(self):
        return {"tag": "null"}

    def _arm(self, value) -> tuple[str, int, Node] | None:
        tag = value.get("tag") if value else "null"
        if tag is None or tag == "null":
            return None
        found = next((x for x in self.arms if x[0] == tag), None)
        if found is None:
            raise CodecError("ErrorInvalidBitFieldValue")
        return found

    def bits(self, value):
        arm = self._arm(value)
        return self.tag_bits + (arm[2].bits(value[arm[0]]) if arm else 0)

    def write(self, w, value):
        arm = self._arm(value)
        w.put(arm[1] if arm else 0, self.tag_bits)
        if arm:
            arm[2].write(w, value.get(arm[0]))

    def read(self, r):
        tag = r.get(self.tag_bits)
        if tag > max(i for _, i, _ in self.options):
            raise CodecError("ErrorValueOverflow")
        for name, i, node in self.arms:
            if i == tag:
                return {"tag": name, name: node.read(r)}
        if tag:
            r.warning = "WarningNotSupportedConfiguration"
        return {"tag": "null"}


#: Arms of the primitive variant in the order of their tags 1 to 19.  Those of the
#: packed kinds (u32p8 to i64p32) are fixed-width on the wire.
PRIMITIVES: tuple[tuple[str, Node], ...] = (
    ("bool", Boolean()), ("u4", Integer(4)), ("u8", Integer(8)), ("i8", Integer(8, True)), ("u16", Integer(16)), ("i16", Integer(16, True)),
    ("u32", Integer(32)), ("i32", Integer(32, True)), ("u64", Integer(64)), ("i64", Integer(64, True)), ("u32p8", Integer(32)), ("u32p16", Integer(32)),
    ("u64p32", Integer(64)), ("i32p8", Integer(32, True)), ("i32p16", Integer(32, True)), ("i64p32", Integer(64, True)), ("f16", Float(5, 10)), ("f32", Float(8, 23)), ("f64", Float(11, 52)),
)


def primitive_variant() -> Variant:
    """The variant of all primitives, with a five-bit tag; its sizes count the tag."""
    return Variant((("null", 0, Null()), *((k, i, n) for i, (k, n) in enumerate(PRIMITIVES, 1))))


@dataclass(frozen=True)
class Text(Node):
    """Five-bit text of up to max_length symbols, controls included; max_bytes bounds the UTF-8 on reading."""

    max_length: int
    terminated: bool = False
    multi: bool = False
    charset: str = "latin"
    table: str = "lower_case"
    utf8_bytes: int | None = None
    leave_before_basic: bool = False

    @property
    def min_bits(self) -> int:
        return 10 if self.terminated else width_of(self.max_length)

    @property
    def max_bits(self) -> int:
        return 5 * self.max_length + (0 if self.terminated else width_of(self.max_length))

    def spark_type(self):
        return T.StringType()

    def default(self):
        return ""

    @property
    def _state(self) -> tuple[bool, bool, int, int]:
        return self.terminated, self.multi, five_bit.CHARSETS[self.charset], five_bit.TABLES[self.table]

    def bits(self, value):
        n = 5 * len(five_bit.symbols(value, *self._state, self.leave_before_basic))
        return n + (0 if self.terminated else width_of(self.max_length))

    def write(self, w, value):
        if value is None:
            raise CodecError("ErrorInvalidBitFieldValue")
        five_bit.write_text(w, five_bit.repair(value) if isinstance(value, bytes) else value, self.max_length, *self._state, self.leave_before_basic)

    def read(self, r):
        return five_bit.read_text(r, self.max_length, *self._state, self.utf8_bytes)


def encode_one(node: Node, value, max_bytes: int | None = None) -> tuple[bytes, int]:
    """(bytes, bits) of one message."""
    w = BitWriter(max_bytes)
    node.write(w, value)
    return w.to_bytes(), w.size


def decode_one(node: Node, data: bytes, bit_len: int | None = None, start: int = 0):
    """(value, end position, warning) of one message."""
    r = BitReader(data, bit_len, start)
    value = node.read(r)
    return value, r.at, r.warning


# The builder API -------------------------------------------------------------


def boolean() -> Boolean:
    return Boolean()


def uint(width: int) -> Integer:
    return Integer(width)


def sint(width: int) -> Integer:
    return Integer(width, True)


def vbr(signed: bool, *segments: int) -> Vbr:
    return Vbr(signed, segments)


def float_(exponent: int, fraction: int) -> Float:
    return Float(exponent, fraction)


def enum(*labels: str, least: int = 0) -> Enumeration:
    return Enumeration(least, least + len(labels) - 1, labels)


def optional(node: Node) -> Optional:
    return Optional(node)


def array(node: Node, most: int, least: int = 0, encoding: str = "three_plus_prefixed") -> Array:
    return Array(node, least, most, encoding)


def buffer(width: int, most: int, least: int = 0, signed: bool = False, encoding: str = "three_plus_prefixed") -> Array:
    return Array(Integer(width, signed), least, most, encoding)


def obj(**fields: Node) -> Object:
    return Object(tuple(fields.items()))


def variant(**arms: tuple[int, Node]) -> Variant:
    return Variant(tuple((k, i, n) for k, (i, n) in arms.items()))


def text(most: int, **how) -> Text:
    return Text(most, **how)
