"""Codecs as Spark columns: no Python on the executors.

Reading.  Fields at a fixed offset are slices of a few bytes, so pruning a
decoded field prunes its work.  After the first field of varying size each
field's end is a column of its own in a projection of its own; Catalyst does not
merge such projections, since that would repeat the expressions.  It would
rewrite a filter over them all the same, so the result of a varying message, and
every encoded payload, is the output of a generator (``sealed``): filters on it
stay above, filters on other columns pass below.

Writing.  A message is a string of binary digits, turned into bytes eight at a
time; objects of up to 63 bits that never vary are one long and shifts.

Floats are arithmetic on doubles: scaling by powers of two is exact, ``rint``
rounds to even.  NaN is written with the quiet bit alone.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitquarry.schema import nodes as N

_LIT = F.lit
Position = int | Column
#: Alternatives that a compiled array or number of groups may have.
MOST_ALTERNATIVES = 64


def shift(name: str, value: Column, n: Position) -> Column:
    """shiftleft, shiftright or shiftrightunsigned by a number or a column."""
    return F.call_function(name, value, _LIT(n) if isinstance(n, int) else n.cast("int"))


def zigzag_encode(c: Column) -> Column:
    """Signed long -> code as a long's bits."""
    c = c.cast("long")
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def zigzag_decode(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(_LIT(1))))


def _unsigned(c: Column) -> Column:
    """A long's 64 bits as decimal(20, 0)."""
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + _LIT(Decimal(1 << 64))).otherwise(d).cast("decimal(20,0)")


def get_bits(payload: Column, at: Position, n: int) -> Column:
    """n bits (64 at most) from a position, as a long; null beyond the payload."""
    if n == 0:
        return _LIT(0).cast("long")
    word = lambda s, digits: F.conv(F.rpad(F.hex(s), digits, "0"), 16, -10).cast("long")
    if isinstance(at, int):
        first, skip = divmod(at, 8)
        size = -(-(skip + n) // 8)
        if size <= 8:
            w = word(F.substring(payload, first + 1, size), 2 * size)
            w = F.shiftrightunsigned(w, 8 * size - skip - n) if 8 * size - skip - n else w
            return w if n == 64 else w.bitwiseAND(_LIT((1 << n) - 1))
    elif n <= 57:
        at = at.cast("int")
        w = word(F.substring(payload, F.shiftright(at, 3) + 1, _LIT(8)), 16)
        w = shift("shiftrightunsigned", w, _LIT(64 - n) - at.bitwiseAND(_LIT(7)))
        return w.bitwiseAND(_LIT((1 << n) - 1))
    return F.shiftleft(get_bits(payload, at, n - 32), 32).bitwiseOR(get_bits(payload, at + (n - 32), 32))


def sealed(df: DataFrame, kept: list[Column], c: Column, out: str) -> DataFrame:
    """df with the columns kept and c, as the one row of a generator, through which no filter on it is rewritten."""
    return df.select(*kept, F.inline(F.array(F.struct(c.alias(out)))))


def scaled(x: Column, k: Column) -> Column:
    """x * 2**k in two exact steps, of which neither leaves the range of doubles."""
    half = F.floor(k / 2)
    return x * F.pow(_LIT(2.0), half) * F.pow(_LIT(2.0), k - half)


def pack_float(c: Column, node: N.Float, let=lambda c: c) -> tuple[Column, Column]:
    """(code as a long's bits, whether a finite value became infinite).

    Rounded to the fraction's width, then, below the smallest normal value,
    again at its last place.
    """
    exponent, fraction = node.exponent, node.fraction
    top, bias = (1 << exponent) - 1, (1 << (exponent - 1)) - 1
    given = let(c.cast("double"))
    x = let(given.cast(node.spark_type()).cast("double"))
    size = F.abs(x)
    finite = ~F.isnan(x) & (size < float("inf"))
    about = let(F.when(finite & (size > 0), F.floor(F.log2(size))))
    part = scaled(size, -about)
    e = let(about + F.when(part >= 2, 1).when(part < 1, -1).otherwise(0))
    rounded = let(F.rint(scaled(size, fraction - e)))
    carried = rounded >= float(1 << (fraction + 1))
    whole = let(F.when(carried, rounded / 2).otherwise(rounded))
    de = let(e + carried.cast("int") + bias)
    small = F.rint(scaled(whole, de - 1)).cast("long")
    body = F.when(de >= top, _LIT(top << fraction)).when(de > 0, F.shiftleft(de.cast("long"), fraction).bitwiseOR(whole.cast("long").bitwiseAND(_LIT((1 << fraction) - 1)))).otherwise(small.bitwiseAND(_LIT((1 << fraction) - 1)))
    body = F.when(F.isnan(x), _LIT(top << fraction | (1 << fraction >> 1))).when(size == float("inf"), _LIT(top << fraction)).when(size == 0, _LIT(0).cast("long")).otherwise(body)
    body = let(body.cast("long"))
    minus = (x < 0) | (x == 0) & x.cast("string").startswith("-")
    code = F.when(minus, body.bitwiseOR(_LIT(_signed(1 << (exponent + fraction))))).otherwise(body)
    return code, ~F.isnan(given) & (F.abs(given) < float("inf")) & (body == top << fraction)


def unpack_float(raw: Column, node: N.Float) -> Column:
    """The value of a code; raw is read several times."""
    exponent, fraction = node.exponent, node.fraction
    top, bias = (1 << exponent) - 1, (1 << (exponent - 1)) - 1
    e = F.shiftrightunsigned(raw, fraction).bitwiseAND(_LIT(top))
    f = raw.bitwiseAND(_LIT((1 << fraction) - 1)).cast("double")
    value = F.when((e == top) & (f != 0), float("nan")).when(e == top, float("inf")).when(e == 0, scaled(f, _LIT(1 - bias - fraction))).otherwise(scaled(f + float(1 << fraction), e - bias - fraction))
    return F.when(F.shiftrightunsigned(raw, exponent + fraction).bitwiseAND(_LIT(1)) == 1, -value).otherwise(value).cast(node.spark_type())


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def reads_natively(node: N.Node) -> bool:
    """Whether expressions can express a node."""
    match node:
        case N.Boolean() | N.Integer() | N.Enumeration():
            return True
        case N.Float():
            # In memory a float or a double must hold all exponents.
            return node.exponent <= (8 if node.max_bits <= 32 else 11) and node.fraction <= 52
        case N.Vbr():
            return len(node.segments) <= MOST_ALTERNATIVES
        case N.Optional():
            return reads_natively(node.type)
        case N.Array():
            return isinstance(node.type, N.Boolean | N.Integer | N.Enumeration) and (not node.delimited or node.max_elements <= MOST_ALTERNATIVES)
        case N.Object():
            return bool(node.fields) and all(reads_natively(n) for _, n in node.fields)
        case N.Variant():
            return all(reads_natively(n) for *_, n in node.arms)
    return False


class _Reader:
    """Adds columns to a frame while it walks a node."""

    def __init__(self, df: DataFrame, payload: Column, size: Column):
        self.df, self.payload, self.size, self.made = df, payload, size, 0
        self.errors: list[Column] = []
        self.error_name: Column | None = None

    def let(self, c: Column) -> Column:
        """c as a column of a projection of its own."""
        name = f"__bit_{self.made}"
        self.made += 1
        self.df = self.df.withColumn(name, c)
        return F.col(name)

    def fail(self, when: Column, code: str, here: Column | None) -> None:
        self.errors.append(F.when(when if here is None else here & when, _LIT(code)))

    def need(self, end: Position, here: Column | None) -> None:
        self.fail((_LIT(end) if isinstance(end, int) else end) > self.size, "ErrorExpectedMoreBits", here)

    def scalar(self, node: N.Node, at: Position) -> Column:
        raw = get_bits(self.payload, at, node.max_bits)
        if isinstance(node, N.Boolean):
            return raw == 1
        if isinstance(node, N.Enumeration):
            if not node.labels:
                return (raw + node.least).cast("int")
            return F.element_at(F.array(*map(_LIT, node.labels)), F.when(raw < len(node.labels), raw.cast("int") + 1))
        if node.signed:
            return zigzag_decode(raw).cast(node.spark_type())
        return _unsigned(raw) if node.width == 64 else raw.cast(node.spark_type())

    def read(self, node: N.Node, at: Position, here: Column | None) -> tuple[Column, Position]:
        """(value, end); here says whether the field is there at all."""
        match node:
            case N.Boolean() | N.Integer() | N.Enumeration():
                end = at + node.max_bits
                self.need(end, here)
                if isinstance(node, N.Enumeration) and node.most - node.least + 1 < 1 << node.max_bits:
                    self.fail(get_bits(self.payload, at, node.max_bits) > node.most - node.least, "ErrorValueOverflow", here)
                return self.scalar(node, at), end
            case N.Float():
                self.need(at + node.max_bits, here)
                return unpack_float(self.let(get_bits(self.payload, at, node.max_bits)), node), at + node.max_bits
            case N.Vbr():
                return self.vbr(node, at, here)
            case N.Optional():
                self.need(at + 1, here)
                there = self.let(get_bits(self.payload, at, 1) == 1)
                value, end = self.read(node.type, at + 1, there if here is None else here & there)
                return F.when(there, value), self.let(F.when(there, _LIT(end) if isinstance(end, int) else end).otherwise(at + 1))
            case N.Array():
                return self.array(node, at, here)
            case N.Object():
                parts = []
                for name, n in node.fields:
                    value, at = self.read(n, at, here)
                    parts.append(value.alias(name))
                return F.struct(*parts), at
            case N.Variant():
                return self.variant(node, at, here)
        raise TypeError(f"{node} has no expression")

    def vbr(self, node: N.Vbr, at: Position, here: Column | None) -> tuple[Column, Position]:
        last = len(node.segments)
        starts = [sum(node.segments[:g]) + g for g in range(last)]
        more = [get_bits(self.payload, at + s, 1) == 1 for s in starts[:-1]]
        k = F.coalesce(*(F.when(~m, _LIT(g)) for g, m in enumerate(more, 1)), _LIT(last))
        k = self.let(k)
        values, code = [], None
        for g, n in enumerate(node.segments):
            part = get_bits(self.payload, at + starts[g] + int(g + 1 < last), n)
            code = part if code is None else F.shiftleft(code, n).bitwiseOR(part)
            values.append(F.when(k == g + 1, code))
        code = F.coalesce(*values)
        if node.signed:
            value = zigzag_decode(code).cast(node.spark_type())
        else:
            value = _unsigned(code) if sum(node.segments) == 64 else code.cast(node.spark_type())
        end = self.let(at + F.element_at(F.array(*(_LIT(node.group_bits(g)) for g in range(1, last + 1))), k))
        self.need(end, here)
        return value, end

    def array(self, node: N.Array, at: Position, here: Column | None) -> tuple[Column, Position]:
        width, kind = node.type.max_bits, node.spark_type()
        step = width
        if node.fixed:
            n, first = _LIT(node.max_elements), at
        elif not node.delimited:
            self.need(at + node.prefix, here)
            n, first = self.let((get_bits(self.payload, at, node.prefix) + node.min_elements).cast("int")), at + node.prefix
            self.fail(n > node.max_elements, "ErrorTooManyElements", here)
        else:
            first = at
            bare = node.min_elements
            marks = [get_bits(self.payload, at + bare * width + k * (width + 1), 1) == 1 for k in range(node.max_elements - bare)]
            n = self.let(F.coalesce(*(F.when(~F.coalesce(m, _LIT(False)), _LIT(bare + k)) for k, m in enumerate(marks)), _LIT(node.max_elements)))
            step = width + 1
        end = first + n * width
        if node.delimited:
            end = end + (n - node.min_elements) + (n < node.max_elements).cast("int")
        end = at + node.max_elements * width if node.fixed and isinstance(at, int) else self.let(end)
        self.need(end, here)
        base = first if not isinstance(first, int) else _LIT(first)

        def element(k: Column) -> Column:
            offset = k * width
            if node.delimited:
                offset = offset + F.greatest(k - node.min_elements + 1, _LIT(0))
            return self.scalar(node.type, base + offset)

        if step and node.fixed:
            value = F.array(*(self.scalar(node.type, first + k * width) for k in range(node.max_elements)))
        else:
            top = F.least(n, _LIT(node.max_elements))
            value = F.when(top > 0, F.transform(F.sequence(_LIT(0), F.greatest(top - 1, _LIT(0))), element)).otherwise(F.array().cast(kind))
        return value, end

    def variant(self, node: N.Variant, at: Position, here: Column | None) -> tuple[Column, Position]:
        self.need(at + node.tag_bits, here)
        tag = self.let(get_bits(self.payload, at, node.tag_bits))
        top = max(i for _, i, _ in node.options)
        if top + 1 < 1 << node.tag_bits:
            self.fail(tag > top, "ErrorValueOverflow", here)
        parts, end, name = [], F.when(_LIT(False), _LIT(0)), F.when(_LIT(False), _LIT(""))
        for arm, i, n in node.arms:
            chosen = tag == i
            value, stop = self.read(n, at + node.tag_bits, chosen if here is None else here & chosen)
            parts.append(F.when(chosen, value).alias(arm))
            end, name = end.when(chosen, _LIT(stop) if isinstance(stop, int) else stop), name.when(chosen, _LIT(arm))
        return F.struct(name.otherwise("null").alias("tag"), *parts), self.let(end.otherwise(at + node.tag_bits))


def decode(df: DataFrame, payload: str, node: N.Node, out: str, bit_len: str | None = None, start: Position = 0) -> DataFrame:
    """df with a column of struct<value, error, bits_read>; a null payload gives null.

    The first failing field in the order of the message names the error, and the
    value is null then.
    """
    p = F.col(payload)
    size = F.octet_length(p) * 8
    r = _Reader(df, p, F.least(F.col(bit_len).cast("int"), size) if bit_len else size)
    value, end = r.read(node, start, None)
    error = F.coalesce(*r.errors, _LIT(None).cast("string")) if r.errors else _LIT(None).cast("string")
    error = r.let(error)
    whole = F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"), F.when(error.isNull(), (_LIT(end) if isinstance(end, int) else end).cast("long") - start).alias("bits_read"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    whole = F.when(p.isNotNull(), whole)
    return sealed(r.df, kept, whole, out) if r.made > 1 else r.df.select(*kept, whole.alias(out))


# Writing ---------------------------------------------------------------------


def digits(value: Column, n: int) -> Column:
    """The n low bits of a long as a string of 0 and 1."""
    return F.substring(F.lpad(F.bin(value), 64, "0"), 65 - n, n) if n else _LIT("")


def digits_to_bytes(bits: Column, most: int | None = None) -> Column:
    """A string of 0 and 1, of up to ``most`` characters, filled with zeros to whole bytes, as binary.

    bits is read several times, so it should be a column that exists.
    """
    word = lambda at: F.lpad(F.conv(F.rpad(F.substring(bits, at, _LIT(64)), 64, "0"), 2, 16), 16, "0")
    words = F.ceil(F.length(bits) / 64).cast("int")
    if most is not None and most <= 64 * 8:
        joined = F.concat(*(F.when(F.length(bits) > 64 * k, word(_LIT(64 * k + 1))).otherwise("") for k in range(max(1, -(-most // 64)))))
    else:
        joined = F.when(words > 0, F.array_join(F.transform(F.sequence(_LIT(0), F.greatest(words - 1, _LIT(0))), lambda k: word(k * 64 + 1)), "")).otherwise("")
    return F.unhex(F.substring(joined, _LIT(1), (F.ceil(F.length(bits) / 8) * 2).cast("int")))


def _code(node: N.Node, c: Column) -> tuple[Column, Column]:
    """(code as a long's bits, whether the value is out of the domain) of a scalar of fixed width."""
    match node:
        case N.Boolean():
            return c.cast("int").cast("long"), _LIT(False)
        case N.Enumeration():
            if node.labels:
                return (F.array_position(F.array(*map(_LIT, node.labels)), c) - 1), ~c.isin(*node.labels)
            return (c - node.least).cast("long"), ~c.between(node.least, node.most)
    wide = node.width == 64 and not node.signed
    outside = _LIT(False) if node.width == 64 and node.signed else ~c.between(_LIT(Decimal(node.least) if wide else node.least), _LIT(Decimal(node.most) if wide else node.most))
    if wide:
        return F.conv(c.cast("string"), 10, -10).cast("long"), outside
    safe = F.when(~outside, c.cast("long"))
    return (zigzag_encode(safe) if node.signed else safe), outside


def _write(node: N.Node, c: Column, let=lambda c: c) -> tuple[Column, Column]:
    """(digits, error code or null) of a value.  let makes a column of what is read several times."""
    none = _LIT(None).cast("string")
    match node:
        case N.Boolean() | N.Integer() | N.Enumeration():
            c = let(c)
            code, outside = _code(node, c)
            return digits(code, node.max_bits), F.when(c.isNull(), _LIT("ErrorInvalidBitFieldValue" if not isinstance(node, N.Enumeration) else "ErrorValueOverflow")).when(outside, _LIT("ErrorValueOverflow"))
        case N.Float():
            c = let(c)
            code, outside = pack_float(c, node, let)
            return digits(code, node.max_bits), F.when(c.isNull(), "ErrorInvalidBitFieldValue").when(outside, "ErrorValueOverflow")
        case N.Vbr():
            c = let(c)
            code, outside = _code(node.whole, c)
            code = let(code)
            k = let(vbr_groups(code, node))
            forms = []
            for groups in range(1, len(node.segments) + 1):
                left, parts = sum(node.segments[:groups]), []
                for g, n in enumerate(node.segments[:groups]):
                    left -= n
                    if g < len(node.segments) - 1:
                        parts.append(_LIT("1" if g + 1 < groups else "0"))
                    parts.append(digits(F.shiftrightunsigned(code, left) if left else code, n))
                forms.append(F.when(k == groups, F.concat(*parts)))
            return F.coalesce(*forms), F.when(c.isNull(), "ErrorInvalidBitFieldValue").when(outside, "ErrorValueOverflow")
        case N.Optional():
            c = let(c)
            bits, error = _write(node.type, c, let)
            return F.when(c.isNull(), "0").otherwise(F.concat(_LIT("1"), bits)), F.when(c.isNotNull(), error)
        case N.Array():
            default = _LIT(node.type.default()).cast(node.type.spark_type())
            v = F.coalesce(let(c), F.array().cast(node.spark_type()))
            if node.min_elements:
                v = F.concat(v, F.array_repeat(default, F.greatest(_LIT(node.min_elements) - F.size(v), _LIT(0))))
            v = let(v)
            one = lambda x: _write(node.type, x)[0]
            marked = (lambda x, k: F.concat(F.when(k >= node.min_elements, "1").otherwise(""), one(x))) if node.delimited else lambda x, k: one(x)
            body = F.array_join(F.transform(v, marked), "")
            if node.delimited:
                body = F.concat(body, F.when(F.size(v) < node.max_elements, "0").otherwise(""))
            elif node.prefix:
                body = F.concat(digits((F.size(v) - node.min_elements).cast("long"), node.prefix), body)
            wrong = F.array_max(F.transform(v, lambda x: _write(node.type, x)[1]))
            return body, F.when(F.size(v) > node.max_elements, "ErrorTooManyElements").otherwise(wrong)
        case N.Object():
            c = let(c)
            parts = [_write(n, c.getField(k), let) for k, n in node.fields]
            return F.concat(*(b for b, _ in parts)), F.when(c.isNull(), "ErrorInvalidBitFieldValue").otherwise(F.coalesce(*(e for _, e in parts), none))
        case N.Variant():
            c = let(c)
            tag = let(c.getField("tag"))
            bits, error = F.when(tag.isNull() | (tag == "null"), digits(_LIT(0).cast("long"), node.tag_bits)), F.when(tag.isNull() | (tag == "null"), none)
            for name, i, n in node.arms:
                b, e = _write(n, c.getField(name), let)
                bits, error = bits.when(tag == name, F.concat(digits(_LIT(i).cast("long"), node.tag_bits), b)), error.when(tag == name, e)
            return bits, error.otherwise("ErrorInvalidBitFieldValue")
    raise TypeError(f"{node} has no expression")


def vbr_groups(code: Column, node: N.Vbr) -> Column:
    """The number of groups that a code takes."""
    total = len(node.segments)
    return F.coalesce(*(F.when(F.shiftrightunsigned(code, sum(node.segments[:k])) == 0, _LIT(k)) for k in range(1, total)), _LIT(total))


def _word(node: N.Node, c: Column) -> tuple[list[tuple[Column, int]], list[Column]] | None:
    """The scalars of an object that never varies, with widths, and their errors."""
    if isinstance(node, N.Object):
        parts = [_word(n, c.getField(k)) for k, n in node.fields]
        return None if None in parts else (sum((p[0] for p in parts), []), sum((p[1] for p in parts), []))
    if isinstance(node, N.Boolean | N.Integer | N.Enumeration) and node.max_bits < 64:
        return [(_code(node, c)[0], node.max_bits)], [_write(node, c)[1]]
    return None


def encode(df: DataFrame, value: Column, node: N.Node, out: str) -> DataFrame:
    """df with a column of struct<payload, bit_len, error>; payload and bit_len are null where there is an error."""
    kept, made = [F.col(f"`{c}`") for c in df.columns if c != out], 0

    def let(c: Column) -> Column:
        nonlocal df, made
        name = f"__put_{made}"
        made += 1
        df = df.withColumn(name, c)
        return F.col(name)

    flat = _word(node, value) if node.min_bits == node.max_bits <= 63 else None
    if flat:
        total, at, word = node.max_bits, node.max_bits, _LIT(0).cast("long")
        size = -(-total // 8)
        for code, n in flat[0]:
            at -= n
            word = word.bitwiseOR(F.shiftleft(code, at + 8 * size - total) if 8 * size <= 63 else F.shiftleft(code, at))
        if 8 * size > 63:
            word = F.shiftleft(word, 8 * size - total)
        error = let(F.coalesce(*flat[1], _LIT(None).cast("string")))
        payload, n = F.unhex(F.right(F.lpad(F.hex(word), 16, "0"), _LIT(2 * size))), _LIT(total)
    else:
        bits, error = _write(node, value, let)
        bits, error = let(bits), let(error)
        payload, n = digits_to_bytes(bits, node.max_bits), F.length(bits)
    # A column of its own, or each later use of the payload would compute it again.
    payload = let(F.when(error.isNull(), payload))
    whole = F.struct(payload.alias("payload"), F.when(error.isNull(), n.cast("long")).alias("bit_len"), error.alias("error"))
    return sealed(df, kept, whole, out)
