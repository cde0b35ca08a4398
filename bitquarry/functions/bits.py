"""Bit strings of one message: a writer, a reader, and the result codes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import total_ordering

#: Result codes in declaration order; the number is the index.
RESULT_CODES = (
    "Ok",
    "WarningNotSupportedConfiguration",
    "ErrorInvalidBitFieldValue",
    "ErrorTooManyElements",
    "ErrorTooManyFragments",
    "ErrorCanNotBeEmpty",
    "ErrorValueOverflow",
    "ErrorExpectedMoreBits",
    "ErrorInsufficentBufferSize",
    "ErrorCanNotWriteNullValue",
    "ErrorCanNotReadNullValue",
    "ErrorTooManyBits",
    "ErrorBadAlloc",
    "ErrorOversizedLength",
    "ErrorOptionalValueIsEmpty",
    "ErrorUnidentifiedError",
)


class CodecError(ValueError):
    """A message that can't be written or read; code is one of RESULT_CODES."""

    def __init__(self, code: str, field: str = ""):
        super().__init__(f"{code} at {field or 'the message'}")
        self.code, self.field = code, field


def width_of(value: int) -> int:
    """Bits that express all values up to this one, at least one."""
    return max(1, value.bit_length())


def zigzag(value: int) -> int:
    return value << 1 if value >= 0 else ((-value) << 1) - 1


def unzigzag(code: int) -> int:
    return -((code + 1) >> 1) if code & 1 else code >> 1


class BitWriter:
    """Bits, the first being the most significant of the first byte.

    max_bytes bounds the storage; once a write fails the writer stays failed.
    Whole bytes go to a buffer, so a long message takes time linear in its bits.
    """

    def __init__(self, max_bytes: int | None = None):
        self.done, self.last, self.size = bytearray(), 0, 0
        self.max_bytes, self.ok = max_bytes, True

    @property
    def value(self) -> int:
        """All bits as one number."""
        n = self.size - 8 * len(self.done)
        return int.from_bytes(self.done, "big") << n | self.last

    def put(self, value: int, n: int, word: int | None = None) -> None:
        """The n low bits of a value; those above are dropped.  word is the widest n."""
        if word is not None and n > word:
            raise CodecError("ErrorTooManyBits")
        if not self.ok or self.max_bytes is not None and self.size + n > 8 * self.max_bytes:
            self.ok = False
            raise CodecError("ErrorInsufficentBufferSize")
        held = self.size - 8 * len(self.done) + n
        self.last = self.last << n | value & ((1 << n) - 1)
        self.size += n
        if held >= 512:
            self.done += (self.last >> held % 8).to_bytes(held // 8, "big")
            self.last &= (1 << held % 8) - 1

    def put_all(self, values: list[int], n: int) -> None:
        """Several values of n bits each, in full or not at all."""
        if not self.ok or self.max_bytes is not None and self.size + n * len(values) > 8 * self.max_bytes:
            self.ok = False
            raise CodecError("ErrorInsufficentBufferSize")
        for v in values:
            self.put(v, n)

    def pad(self, n: int) -> None:
        self.put(0, n)

    def to_bytes(self) -> bytes:
        """With zeros after the last bit up to a whole byte."""
        n = self.size - 8 * len(self.done)
        size = -(-n // 8)
        return bytes(self.done) + (self.last << (8 * size - n)).to_bytes(size, "big")


class BitReader:
    """Reads bits from a position on; bit_len may leave out some of the last byte."""

    def __init__(self, data: bytes, bit_len: int | None = None, start: int = 0):
        self.data, self.at = data, start
        total = 8 * len(data)
        self.size = total if bit_len is None else min(bit_len, total)
        self.warning: str | None = None

    def has(self, n: int) -> bool:
        return self.at + n <= self.size

    def get(self, n: int, word: int | None = None) -> int:
        if word is not None and n > word:
            raise CodecError("ErrorTooManyBits")
        if not self.has(n):
            raise CodecError("ErrorExpectedMoreBits")
        first, end = self.at >> 3, (self.at + n + 7) >> 3
        self.at += n
        return int.from_bytes(self.data[first:end], "big") >> (8 * end - self.at) & ((1 << n) - 1)

    def peek_all(self, count: int, n: int) -> list[int]:
        """count values of n bits each, the position unmoved."""
        begin, out = self.at, []
        for at in range(0, count, 96):
            some = min(96, count - at)
            word = self.get(some * n)
            out += [word >> n * k & ((1 << n) - 1) for k in range(some - 1, -1, -1)]
        self.at = begin
        return out


@total_ordering
@dataclass(frozen=True)
class BitSize:
    """A number of bits that never falls below zero; bytes and odd bits are its parts."""

    bits: int = 0

    def __post_init__(self):
        if self.bits < 0:
            raise ValueError("a size below zero")

    whole_bytes = property(lambda self: self.bits // 8)
    odd_bits = property(lambda self: self.bits % 8)

    def __add__(self, other: "BitSize | int") -> "BitSize":
        return BitSize(self.bits + int(other))

    def __sub__(self, other: "BitSize | int") -> "BitSize":
        return BitSize(self.bits - int(other))

    def __mul__(self, times: int) -> "BitSize":
        return BitSize(self.bits * times)

    def __lt__(self, other: "BitSize | int") -> bool:
        return self.bits < int(other)

    def __int__(self) -> int:
        return self.bits


def byte_size(bits: int) -> int:
    return -(-bits // 8)


def growable_buffer_bytes(min_bits: int, max_bits: int, percent: int) -> int:
    """Bytes to reserve for a growing buffer: a share of the range above the smallest message."""
    low, high = byte_size(min_bits), byte_size(max_bits)
    return low + (high - low) * min(max(percent, 0), 100) // 100
