"""Registered queries of the codec layer and their DuckDB oracles.

Each query is a pair: a function of (spark, sf_dir) and the SQL that gives the
same rows (None where SQL can't).  All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitquarry.functions import columns as C
from bitquarry.operators import native, packed
from bitquarry.schema import nodes as N
from bitquarry.schema.compiler import compile_text
from bitquarry.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function by its name with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: 53 bits in seven bytes.
LINE = N.obj(orderkey=N.uint(32), linenumber=N.uint(4), qty=N.sint(16), returned=N.boolean())
#: Varying parts: vbr, optional, enumeration, array.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORDER = N.obj(orderkey=N.vbr(False, 7, 7, 7, 7), priority=N.enum(*PRIORITIES), cents=N.optional(N.uint(40)))
ORDER_KEY = N.vbr(False, 7, 7, 7, 7)
EVENT = N.variant(click=(1, N.obj(user=N.uint(16), cents=N.uint(20))), view=(2, N.uint(16)), purchase=(3, N.obj(user=N.uint(16), cents=N.vbr(False, 8, 8, 8))), error=(4, N.boolean()), signup=(6, N.uint(16)))
READING = N.obj(user=N.uint(20), cents=N.vbr(True, 8, 8, 16))


def _line(t: DataFrame):
    return F.struct(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), (F.col("l_quantity").cast("int") - 25).alias("qty"), (F.col("l_returnflag") == "R").alias("returned"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as packed payloads."""
    t = read(spark, sf_dir, "lineitem")
    return packed.encode(t, _line(t), LINE).select(F.col("encoded.payload").alias("payload"))


def decoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.decode(lines(spark, sf_dir), "payload", LINE).select("decoded.value.*")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as packed payloads; cheap ones have no price."""
    t = read(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    value = F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_totalprice") >= 100000, cents).alias("cents"))
    return packed.encode(t, value, ORDER).select(F.col("encoded.payload").alias("payload"), F.col("encoded.bit_len").alias("bit_len"))


def decoded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.decode(orders(spark, sf_dir), "payload", ORDER, bit_len="bit_len").select("decoded.value.*")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack lineitem, decode it, aggregate: one scan and one shuffle of partial sums."""
    return decoded_lines(spark, sf_dir).groupBy("returned").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("sum_qty"), F.max("linenumber").cast("int").alias("max_line"))


QUERIES["unpack_groupby_flag"] = flagship
ORACLE_SQL["unpack_groupby_flag"] = "SELECT l_returnflag = 'R' AS returned, count(*) AS n, sum(CAST(l_quantity AS BIGINT) - 25)::BIGINT AS sum_qty, max(l_linenumber) AS max_line FROM lineitem GROUP BY 1"

_Q = "(CAST(l_quantity AS BIGINT) - 25)"
_ZZ = f"(CASE WHEN {_Q} >= 0 THEN 2 * {_Q} ELSE -2 * {_Q} - 1 END)"


@query(f"SELECT l_orderkey, l_linenumber, {_Q} AS qty, {_ZZ} AS code FROM lineitem")
def zigzag_lineitem(spark, sf_dir):
    qty = F.col("l_quantity").cast("long") - 25
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", qty.alias("qty"), C.zigzag_encode(qty).alias("code"))
    return t.select("l_orderkey", "l_linenumber", C.zigzag_decode(F.col("code")).alias("qty"), "code")


@query(f"SELECT l_orderkey, l_linenumber, upper(lpad(to_base(((l_orderkey * 2097152 + l_linenumber::BIGINT * 131072 + {_ZZ} * 2 + (l_returnflag = 'R')::BIGINT) * 8), 16), 14, '0')) AS payload_hex FROM lineitem")
def pack_u32_u4_i16_b1(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem")
    return packed.encode(t, _line(t), LINE).select("l_orderkey", "l_linenumber", F.hex("encoded.payload").alias("payload_hex"))


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, CAST(l_quantity AS INTEGER) - 25 AS qty, l_returnflag = 'R' AS returned FROM lineitem")
def roundtrip_lineitem(spark, sf_dir):
    return decoded_lines(spark, sf_dir).select("orderkey", F.col("linenumber").cast("int").alias("linenumber"), F.col("qty").cast("int").alias("qty"), "returned")


@query("SELECT l_orderkey AS orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def pruned_field_filter(spark, sf_dir):
    """Two of four fields are decoded: the filter's and the key's."""
    t = packed.select_fields(lines(spark, sf_dir), "payload", LINE, "returned", "orderkey")
    return t.where("returned").groupBy("orderkey").agg(F.count(F.lit(1)).alias("n"))


_K = "(CASE WHEN l_orderkey < 128 THEN 8 WHEN l_orderkey < 16384 THEN 16 WHEN l_orderkey < 2097152 THEN 24 ELSE 31 END)"


@query(f"SELECT {_K} AS bits, count(*) AS n FROM lineitem GROUP BY 1")
def vbr_len_histogram(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(C.vbr_bits(F.col("l_orderkey"), ORDER_KEY).alias("bits")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderkey, o_orderkey AS back, CASE WHEN o_orderkey < 128 THEN upper(lpad(to_base(o_orderkey, 16), 2, '0'))
    WHEN o_orderkey < 16384 THEN upper(lpad(to_base(32768 + (o_orderkey // 128) * 256 + o_orderkey % 128, 16), 4, '0'))
    WHEN o_orderkey < 2097152 THEN upper(lpad(to_base(8421376 + (o_orderkey // 16384) * 65536 + ((o_orderkey // 128) % 128) * 256 + o_orderkey % 128, 16), 6, '0')) END AS payload_hex FROM orders"""
)
def vbr_encode_hex(spark, sf_dir):
    t = packed.encode(read(spark, sf_dir, "orders"), F.col("o_orderkey"), ORDER_KEY)
    t = packed.decode(t.withColumn("payload", F.col("encoded.payload")), "payload", ORDER_KEY)
    return t.select("o_orderkey", F.col("decoded.value").cast("long").alias("back"), F.hex("payload").alias("payload_hex"))


@query("SELECT o_orderkey AS orderkey, o_orderpriority AS priority, CASE WHEN o_totalprice >= 100000 THEN round(o_totalprice * 100)::BIGINT END AS cents FROM orders")
def roundtrip_orders(spark, sf_dir):
    return decoded_orders(spark, sf_dir).select(F.col("orderkey").cast("long").alias("orderkey"), "priority", "cents")


@query("SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS code, upper(lpad(to_base((CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 32, 16), 2, '0')) AS payload_hex FROM orders")
def enum_priority_codes(spark, sf_dir):
    t = packed.encode(read(spark, sf_dir, "orders"), F.col("o_orderpriority"), N.enum(*PRIORITIES)).withColumn("payload", F.col("encoded.payload"))
    t = packed.decode(t, "payload", N.Enumeration(0, 4))
    return t.select("o_orderkey", F.col("decoded.value").alias("code"), F.hex("payload").alias("payload_hex"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS nation, CASE WHEN c_acctbal < 0 THEN 1 ELSE 9 END AS bits FROM customer")
def optional_nation_bits(spark, sf_dir):
    node = N.optional(N.uint(8))
    t = packed.encode(read(spark, sf_dir, "customer"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")), node)
    t = packed.decode(t.withColumn("payload", F.col("encoded.payload")), "payload", node)
    return t.select("c_custkey", F.col("decoded.value").cast("int").alias("nation"), F.col("encoded.bit_len").cast("int").alias("bits"))


def _numbers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("short"))).alias("numbers"))


@query(
    """SELECT l_orderkey, n, total, 5 + 4 * n AS bits FROM (SELECT l_orderkey, len(v)::INTEGER AS n, list_sum(v)::BIGINT AS total
    FROM (SELECT l_orderkey, list_sort(list(l_linenumber)) AS v FROM lineitem GROUP BY 1))"""
)
def array_prefixed_linenumbers(spark, sf_dir):
    node = N.buffer(4, 30, encoding="prefixed")
    t = packed.encode(_numbers(spark, sf_dir), F.col("numbers"), node)
    t = packed.decode(t.withColumn("payload", F.col("encoded.payload")), "payload", node)
    v = F.col("decoded.value")
    return t.select("l_orderkey", F.size(v).alias("n"), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("encoded.bit_len").cast("int").alias("bits"))


@query(
    """SELECT l_orderkey, numbers, array_to_string(list_transform(range(1, length(d), 4), lambda i: substr('0123456789ABCDEF', 1 + 8 * substr(d, i, 1)::INTEGER + 4 * substr(d, i + 1, 1)::INTEGER + 2 * substr(d, i + 2, 1)::INTEGER + substr(d, i + 3, 1)::INTEGER, 1)), '') AS payload_hex
    FROM (SELECT l_orderkey, numbers, rpad(d, 8 * ((length(d) + 7) // 8)::INTEGER, '0') AS d FROM
    (SELECT l_orderkey, array_to_string(v, ',') AS numbers, array_to_string(list_transform(v, lambda x: '1' || lpad(to_base(x, 2), 4, '0')), '') || CASE WHEN len(v) < 30 THEN '0' ELSE '' END AS d
    FROM (SELECT l_orderkey, list_sort(list(l_linenumber)) AS v FROM lineitem GROUP BY 1)))"""
)
def array_delimited_small(spark, sf_dir):
    """Whole lists of up to 30, each element after a one, a zero at the end of shorter ones."""
    node = N.buffer(4, 30, encoding="delimited")
    t = packed.encode(_numbers(spark, sf_dir), F.col("numbers"), node)
    t = packed.decode(t.withColumn("payload", F.col("encoded.payload")), "payload", node)
    return t.select("l_orderkey", F.array_join(F.transform(F.col("decoded.value"), lambda x: x.cast("string")), ",").alias("numbers"), F.hex("payload").alias("payload_hex"))


def user_low(user: Column) -> Column:
    """What an event's message has of a user's number."""
    return user.cast("long").bitwiseAND(F.lit(0xFFFF)).cast("int")


def whole_user(block: Column, low: Column) -> Column:
    return F.shiftleft(block, 16) + low


def events(spark: SparkSession, sf_dir: str, *beside: str) -> DataFrame:
    """events as packed variants; a message has 16 bits of its user's number, the column block has those above.  Columns beside are kept."""
    t = read(spark, sf_dir, "events")
    user, cents = user_low(F.col("user_id")), F.round(F.col("value") * 100).cast("int")
    is_ = lambda k: F.col("event_type") == k
    pair = F.struct(user.alias("user"), cents.alias("cents"))
    value = F.struct(F.col("event_type").alias("tag"), F.when(is_("click"), pair).alias("click"), F.when(is_("view"), user).alias("view"), F.when(is_("purchase"), pair).alias("purchase"), F.when(is_("error"), F.col("value") > 10).alias("error"), F.when(is_("signup"), user).alias("signup"))
    return packed.encode(t, value, EVENT).select("event_id", *beside, F.shiftright(F.col("user_id").cast("long"), 16).alias("block"), F.col("encoded.payload").alias("payload"), F.col("encoded.bit_len").alias("bit_len"))


@query(
    """SELECT event_type AS tag, count(*) AS n, sum(CASE WHEN event_type IN ('click', 'purchase') THEN round(value * 100)::BIGINT END)::BIGINT AS cents,
    sum(CASE WHEN event_type IN ('click', 'purchase', 'view', 'signup') THEN user_id END)::BIGINT AS users, count(*) FILTER (event_type = 'error' AND value > 10) AS high_errors,
    sum(3 + CASE event_type WHEN 'click' THEN 36 WHEN 'purchase' THEN 16 + CASE WHEN round(value * 100) < 256 THEN 9 WHEN round(value * 100) < 65536 THEN 18 ELSE 26 END WHEN 'error' THEN 1 ELSE 16 END)::BIGINT AS bits FROM events GROUP BY 1"""
)
def variant_event_payload(spark, sf_dir):
    t = packed.decode(events(spark, sf_dir), "payload", EVENT, bit_len="bit_len")
    v = F.col("decoded.value")
    cents = F.coalesce(C.get_arm(v, "click")["cents"], C.get_arm(v, "purchase")["cents"])
    users = F.coalesce(C.get_arm(v, "click")["user"], C.get_arm(v, "purchase")["user"], v["view"], v["signup"])
    return t.groupBy(v["tag"].alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"), F.sum(whole_user(F.col("block"), users)).alias("users"), F.count_if(F.coalesce(v["error"], F.lit(False))).alias("high_errors"), F.sum("bit_len").alias("bits"))


@query(f"SELECT o_orderkey, ({_K.replace('l_orderkey', 'o_orderkey')} + 3 + CASE WHEN o_totalprice >= 100000 THEN 41 ELSE 1 END)::BIGINT AS bits FROM orders")
def bit_size_by_order(spark, sf_dir):
    t = read(spark, sf_dir, "orders")
    cents = F.when(F.col("o_totalprice") >= 100000, F.round(F.col("o_totalprice") * 100).cast("long"))
    return packed.bit_size(t, F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), cents.alias("cents")), ORDER).select("o_orderkey", "bits")


def _arithmetic(op: str, node: N.Integer, raw: str, zero: str = "FALSE"):
    """A query of l_linenumber (less an offset) op l_quantity (folded), and its SQL."""
    a = f"(l_linenumber - {0 if not node.signed else 4})"
    b = f"(CAST(l_quantity AS INTEGER) % 12 - {0 if not node.signed else 6})"
    expression = raw.format(a=a, b=b)

    def run(spark, sf_dir):
        t = read(spark, sf_dir, "lineitem")
        x, y = F.col("l_linenumber") - (4 if node.signed else 0), F.col("l_quantity").cast("int") % 12 - (6 if node.signed else 0)
        r = C.checked(op, x, y, node)
        return t.groupBy(x.alias("a"), y.alias("b"), r["value"].cast("int").alias("result"), r["error"].alias("error")).agg(F.count(F.lit(1)).alias("n"))

    bad = zero.format(b=b)
    sql = f"""SELECT a, b, CASE WHEN bad OR raw NOT BETWEEN {node.least} AND {node.most} THEN NULL ELSE raw END::INTEGER AS result,
    CASE WHEN bad THEN 'ErrorInvalidBitFieldValue' WHEN raw NOT BETWEEN {node.least} AND {node.most} THEN 'ErrorValueOverflow' END AS error, count(*) AS n
    FROM (SELECT {a} AS a, {b} AS b, {bad} AS bad, {expression} AS raw FROM lineitem) GROUP BY ALL"""
    return run, sql


for _name, _args in {
    "checked_add_u4": ("add", N.uint(4), "{a} + {b}"),
    "checked_sub_u4": ("sub", N.uint(4), "{a} - {b}"),
    "checked_mul_i4": ("mul", N.sint(4), "{a} * {b}"),
    "checked_div_i8": ("div", N.sint(8), "CASE WHEN {b} = 0 THEN 0 ELSE trunc({a} / {b}) END", "{b} = 0"),
}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _arithmetic(*_args)


@query(
    """SELECT c_custkey, CASE WHEN x = 0 THEN 0 ELSE sign(x) * round_even(abs(x) / step, 0) * step END AS quantized FROM
    (SELECT c_custkey, x, pow(2, floor(log2(CASE WHEN x = 0 THEN 1 ELSE abs(x) END)) - 7) AS step FROM (SELECT c_custkey, c_acctbal::FLOAT::DOUBLE AS x FROM customer))"""
)
def quantize_bf16_acctbal(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", C.quantize_float(F.col("c_acctbal"), 8, 7).cast("double").alias("quantized"))


@query("SELECT p_partkey, p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part")
def float_roundtrip_part(spark, sf_dir):
    """float64 keeps the price bit by bit, float16 the small whole sizes."""
    node = N.obj(price=N.float_(11, 52), size=N.float_(5, 10))
    t = read(spark, sf_dir, "part")
    t = packed.encode(t, F.struct(F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size")), node).withColumn("payload", F.col("encoded.payload"))
    t = packed.decode(t, "payload", node)
    return t.select("p_partkey", F.col("decoded.value.price").alias("p_retailprice"), F.col("decoded.value.size").cast("double").alias("p_size"))


_NAMES = N.text(64)


@query("SELECT n_name AS name, n_name AS back FROM nation UNION ALL SELECT r_name, r_name FROM region UNION ALL SELECT DISTINCT c_mktsegment, c_mktsegment FROM customer")
def b5_roundtrip_names(spark, sf_dir):
    t = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(read(spark, sf_dir, "region").select("r_name")).union(read(spark, sf_dir, "customer").select("c_mktsegment").distinct())
    t = packed.encode(t, F.col("name"), _NAMES).withColumn("payload", F.col("encoded.payload"))
    return packed.decode(t, "payload", _NAMES).select("name", F.col("decoded.value").alias("back"))


@query("SELECT c_custkey, c_mktsegment, length(c_mktsegment) + 1 AS symbols, 7 + 5 * (length(c_mktsegment) + 1) AS bits FROM customer")
def b5_symbol_count_upper(spark, sf_dir):
    """Capitals take a switch of table and five bits each."""
    t = packed.bit_size(read(spark, sf_dir, "customer"), F.col("c_mktsegment"), _NAMES)
    return t.select("c_custkey", "c_mktsegment", F.expr("(bits - 7) div 5").alias("symbols"), "bits")


@query(
    f"""SELECT kept, error, count(*) AS n FROM (SELECT o_orderkey % 9 AS kept, CASE WHEN 8 * least(o_orderkey % 9, (bits + 7) // 8) < bits THEN 'ErrorExpectedMoreBits' END AS error
    FROM (SELECT o_orderkey, {_K.replace("l_orderkey", "o_orderkey")} + 3 + CASE WHEN o_totalprice >= 100000 THEN 41 ELSE 1 END AS bits FROM orders)) GROUP BY ALL"""
)
def decode_error_codes(spark, sf_dir):
    """Payloads cut to orderkey mod 9 bytes: errors are rows, not failures."""
    t = read(spark, sf_dir, "orders")
    cents = F.when(F.col("o_totalprice") >= 100000, F.round(F.col("o_totalprice") * 100).cast("long"))
    t = packed.encode(t, F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), cents.alias("cents")), ORDER)
    t = t.select((F.col("o_orderkey") % 9).alias("kept"), F.substring(F.col("encoded.payload"), F.lit(1), (F.col("o_orderkey") % 9).cast("int")).alias("payload"))
    return packed.decode(t, "payload", ORDER).groupBy("kept", F.col("decoded.error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey AS nation, message_no, s_suppkey AS supplier FROM (SELECT s_nationkey, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INTEGER AS message_no FROM supplier)")
def explode_back_to_back(spark, sf_dir):
    """Messages of 17 bits each, one after the other in one payload for each nation."""
    node = N.obj(supplier=N.uint(17))
    t = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    bits = F.array_join(F.transform("keys", lambda k: native.digits(k, 17)), "")
    t = t.withColumn("bits", bits).select(F.col("s_nationkey").alias("nation"), native.digits_to_bytes(F.col("bits")).alias("payload"), F.size("keys").alias("n"))
    return packed.explode_messages(t, "payload", node, count="n").select("nation", "message_no", F.col("message.value.supplier").cast("long").alias("supplier"))


@query("SELECT s_nationkey AS nation, count(*) AS suppliers, sum(round(s_acctbal * 100)::BIGINT)::BIGINT AS cents FROM supplier GROUP BY 1")
def array_of_objects(spark, sf_dir):
    """A list of objects with a varying part, through the Arrow engine."""
    node = compile_text(
        """
types:
  supplier: {kind: object, fields: {id: u32, cents: {kind: vbr_integer, signed: true, segments: [12, 12, 8]}, note: {kind: optional, type: {kind: b5_string, max_length: 40}}}}
  suppliers: {kind: array, max_elements: 100000, type: supplier}
"""
    )["suppliers"]
    one = F.struct(F.col("s_suppkey").alias("id"), F.round(F.col("s_acctbal") * 100).cast("int").alias("cents"), F.when(F.col("s_acctbal") < 0, F.lit("below zero")).alias("note"))
    t = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_list(one).alias("all"))
    t = packed.encode(t, F.col("all"), node).select("nation", F.col("encoded.payload").alias("payload"))
    return packed.decode(t, "payload", node).select("nation", F.explode("decoded.value").alias("s")).groupBy("nation").agg(F.count(F.lit(1)).alias("suppliers"), F.sum("s.cents").alias("cents"))


@query("SELECT l_linenumber, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty FROM lineitem GROUP BY 1")
def primitive_variants(spark, sf_dir):
    """Line numbers as u4 and quantities as i16 in the variant of all primitives."""
    node = N.primitive_variant()
    arms = [k for k, _, _ in node.arms]

    def of(name, c):
        kinds = {k: n.spark_type() for k, _, n in node.arms}
        return F.struct(F.lit(name).alias("tag"), *((c if k == name else F.lit(None)).cast(kinds[k]).alias(k) for k in arms))

    t = read(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_quantity").agg(F.count(F.lit(1)).alias("rows"))
    t = packed.encode(t, of("u4", F.col("l_linenumber")), node, "a")
    t = packed.encode(t, of("i16", F.col("l_quantity")), node, "b").select(F.col("a.payload").alias("a"), F.col("b.payload").alias("b"), "rows")
    t = packed.decode(packed.decode(t, "a", node, "x"), "b", node, "y")
    return t.groupBy(F.col("x.value.u4").cast("int").alias("l_linenumber")).agg(F.sum("rows").alias("n"), F.sum(F.col("y.value.i16").cast("long") * F.col("rows")).alias("qty"))


# Relational operators over decoded frames --------------------------------------


@query("SELECT o_orderpriority AS priority, count(*) AS n, sum(CAST(l_quantity AS BIGINT) - 25)::BIGINT AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def join_decoded(spark, sf_dir):
    a, b = decoded_lines(spark, sf_dir), decoded_orders(spark, sf_dir).select("orderkey", "priority")
    return a.join(b, "orderkey").groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_decoded(spark, sf_dir):
    back = decoded_lines(spark, sf_dir).where("returned").select("orderkey")
    return decoded_orders(spark, sf_dir).join(back, "orderkey", "left_anti").select(F.col("orderkey").cast("long").alias("orderkey"))


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def semi_join_decoded(spark, sf_dir):
    seventh = decoded_lines(spark, sf_dir).where("linenumber = 7").select("orderkey")
    return decoded_orders(spark, sf_dir).join(seventh, "orderkey", "left_semi").select(F.col("orderkey").cast("long").alias("orderkey"))


@query("SELECT o_orderpriority AS priority, o_orderkey AS orderkey, round(o_totalprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice * 100) DESC, o_orderkey)::INTEGER AS rank FROM orders WHERE o_totalprice >= 100000 QUALIFY rank <= 5")
def window_top_decoded(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("priority").orderBy(F.desc("cents"), "orderkey"))
    t = decoded_orders(spark, sf_dir).where("cents is not null")
    return t.select("priority", F.col("orderkey").cast("long").alias("orderkey"), "cents", rank.alias("rank")).where("rank <= 5")


@query("SELECT l_returnflag = 'R' AS returned, l_linenumber AS linenumber, count(*) AS n FROM lineitem GROUP BY ROLLUP (1, 2)")
def rollup_decoded(spark, sf_dir):
    t = decoded_lines(spark, sf_dir).select("returned", F.col("linenumber").cast("int").alias("linenumber"))
    return t.rollup("returned", "linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag = 'R' AS returned, l_linenumber AS linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (1, 2)")
def cube_decoded(spark, sf_dir):
    t = decoded_lines(spark, sf_dir).select("returned", F.col("linenumber").cast("int").alias("linenumber"))
    return t.cube("returned", "linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1")
def set_operations_decoded(spark, sf_dir):
    t = decoded_lines(spark, sf_dir)
    keys = lambda w: t.where(w).select("orderkey")
    return keys("returned").intersect(keys("not returned")).subtract(keys("linenumber = 1"))


@query("SELECT l_orderkey AS orderkey, count(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY 1")
def distinct_decoded(spark, sf_dir):
    return decoded_lines(spark, sf_dir).groupBy("orderkey").agg(F.countDistinct("linenumber").alias("lines"))


@query("SELECT o_orderkey AS orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders WHERE o_totalprice >= 100000 ORDER BY cents DESC, orderkey LIMIT 20")
def topk_decoded(spark, sf_dir):
    t = decoded_orders(spark, sf_dir).where("cents is not null").orderBy(F.desc("cents"), "orderkey").limit(20)
    return t.select(F.col("orderkey").cast("long").alias("orderkey"), "cents")


# Streaming ---------------------------------------------------------------------


def reading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of (ts, payload)."""
    schema = read(spark, sf_dir, "events").schema
    # A glob, since a stream's plain path must be a folder and the table may be one file.
    t = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    value = F.struct(F.col("user_id").cast("int").alias("user"), F.round(F.col("value") * 100).cast("int").alias("cents"))
    return packed.encode(t, value, READING).select(F.col("ts").cast("timestamp").alias("ts"), F.col("encoded.payload").alias("payload"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, user_id::INTEGER AS user, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL")
def stream_windowed_decode(spark, sf_dir):
    t = windows.drained(windows.windowed(reading_stream(spark, sf_dir), "payload", READING, "ts", "user", "cents", "1 day"))
    return t.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "user", "n", "total")


@query(
    """SELECT user_id::INTEGER AS user, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM
    (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INTEGER AS fresh FROM events))
    GROUP BY ALL) GROUP BY 1"""
)
def stream_sessions(spark, sf_dir):
    t = windows.drained(windows.sessions(reading_stream(spark, sf_dir), "payload", READING, "ts", "user"))
    return t.groupBy("user").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
