"""Registered queries of joins by order, grouping sets, streams, modes, bounds and the rest of the field types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.functions import columns as C
from bitquarry.operators import joins, packed
from bitquarry.plans.queries import _K, EVENT, ORDER, READING, decoded_lines, decoded_orders, events, orders, query, read, reading_stream, user_low, whole_user
from bitquarry.schema import nodes as N
from bitquarry.streaming import windows

# Joins ---------------------------------------------------------------------------

#: Seconds of a bucket of the ordered joins.
_HOUR, _DAY = 3600, 86400


def _readings(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of a kind as decoded messages: user, cents, event, at (seconds)."""
    t = read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    value = F.struct(F.col("user_id").cast("int").alias("user"), F.round(F.col("value") * 100).cast("int").alias("cents"))
    t = packed.encode(t, value, READING).select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("encoded.payload").alias("payload"))
    t = packed.decode(t, "payload", READING)
    return t.select(F.col("decoded.value.user").alias("user"), "at", F.col("event_id").cast("long").alias("event"), F.col("decoded.value.cents").alias("cents"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS sec, round(value * 100)::INTEGER AS cents FROM events WHERE event_type IN ('click', 'purchase')),
    w AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER o AS last_event,
    last_value(CASE WHEN event_type = 'click' THEN sec END IGNORE NULLS) OVER o AS last_at FROM e
    WINDOW o AS (PARTITION BY user_id ORDER BY sec, event_type = 'purchase', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id::BIGINT AS event, user_id::INTEGER AS user, last_event::BIGINT AS last_event, sec - last_at AS age FROM w WHERE event_type = 'purchase'"""
)
def asof_join_decoded(spark, sf_dir):
    """Each purchase with its user's latest click at or before it."""
    t = joins.asof_join(_readings(spark, sf_dir, "purchase").drop("cents"), _readings(spark, sf_dir, "click").drop("cents"), "user", "at", 7 * _DAY)
    return t.select("event", "user", "last_event", (F.col("at") - F.col("last_at")).alias("age"))


@query(
    """SELECT r_regionkey::INTEGER AS band, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem JOIN region ON CAST(l_quantity AS INTEGER) - 25 BETWEEN r_regionkey * 9 - 25 AND r_regionkey * 9 - 25 + 13 GROUP BY 1"""
)
def range_join_decoded(spark, sf_dir):
    """Quantities in overlapping bands."""
    low = F.col("r_regionkey").cast("int") * 9 - 25
    bands = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("band"), low.alias("low"), (low + 13).alias("high"))
    t = joins.range_join(decoded_lines(spark, sf_dir).select(F.col("qty").cast("int").alias("qty"), "linenumber"), "qty", bands, "low", "high", 8)
    return t.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("linenumber").cast("long").alias("lines"))


@query(
    """SELECT p.user_id::INTEGER AS user, count(*) AS pairs FROM events p JOIN events c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click'
    AND floor(epoch(c.ts))::BIGINT BETWEEN floor(epoch(p.ts))::BIGINT - 86400 AND floor(epoch(p.ts))::BIGINT GROUP BY 1"""
)
def interval_join_decoded(spark, sf_dir):
    """Clicks in the day before each purchase, by user."""
    p = _readings(spark, sf_dir, "purchase").select("user", (F.col("at") - _DAY).alias("low"), F.col("at").alias("high"))
    return joins.range_join(_readings(spark, sf_dir, "click").select("user", "at"), "at", p, "low", "high", _DAY, "user").groupBy("user").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT r_name AS region, count(n_name) AS before FROM region LEFT JOIN nation ON n_name < r_name GROUP BY 1")
def nested_loop_join(spark, sf_dir):
    """A join by inequality of text alone: a nested loop over tables of a few rows."""
    node = N.obj(key=N.uint(8), name=N.text(64))
    t = read(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("v"))
    t = packed.decode(packed.encode(t, F.col("v"), node).select(F.col("encoded.payload").alias("payload")), "payload", node).select("decoded.value.name")
    r = read(spark, sf_dir, "region")
    return r.join(t, t["name"] < r["r_name"], "left").groupBy(F.col("r_name").alias("region")).agg(F.count("name").alias("before"))


@query("SELECT coalesce(o, l) AS orderkey, o IS NULL AS no_order, l IS NULL AS no_line FROM (SELECT o_orderkey AS o FROM orders WHERE o_totalprice >= 100000) FULL JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem WHERE l_linenumber = 6) ON o = l")
def full_outer_join_decoded(spark, sf_dir):
    o = decoded_orders(spark, sf_dir).where("cents is not null").select(F.col("orderkey").cast("long").alias("o"))
    r = decoded_lines(spark, sf_dir).where("linenumber = 6").select(F.col("orderkey").alias("l")).distinct()
    return o.join(r, o.o == r.l, "full").select(F.coalesce("o", "l").alias("orderkey"), F.col("o").isNull().alias("no_order"), F.col("l").isNull().alias("no_line"))


# Aggregation -----------------------------------------------------------------------


@query("SELECT returned, linenumber, count(*) AS n, grouping_id(returned, linenumber)::INTEGER AS level FROM (SELECT l_returnflag = 'R' AS returned, l_linenumber AS linenumber FROM lineitem) GROUP BY GROUPING SETS ((returned, linenumber), (linenumber), ())")
def grouping_sets_decoded(spark, sf_dir):
    t = decoded_lines(spark, sf_dir).select("returned", F.col("linenumber").cast("int").alias("linenumber"))
    sets = [[F.col("returned"), F.col("linenumber")], [F.col("linenumber")], []]
    return t.groupingSets(sets, "returned", "linenumber").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("returned", "linenumber").cast("int").alias("level"))


@query("SELECT l_linenumber AS linenumber, count(DISTINCT l_orderkey) AS orders, TRUE AS near FROM lineitem GROUP BY 1")
def approx_distinct_decoded(spark, sf_dir):
    """Exact counts, and whether the sketch of 2 % comes within 8 % of them.

    The pairs are made distinct first: in one aggregate with an exact count, each pair would carry a sketch of 3 kB through the shuffle.
    """
    t = decoded_lines(spark, sf_dir).select(F.col("linenumber").cast("int").alias("linenumber"), "orderkey").distinct()
    t = t.groupBy("linenumber").agg(F.count("orderkey").alias("orders"), F.approx_count_distinct("orderkey", 0.02).alias("about"))
    return t.select("linenumber", "orders", (F.abs(F.col("about") - F.col("orders")) <= F.col("orders") * 0.08 + 1).alias("near"))


@query("SELECT o_orderpriority AS priority, percentile_disc(0.5) WITHIN GROUP (ORDER BY round(o_totalprice * 100)::BIGINT) AS middle, max(o_orderkey) AS last FROM orders WHERE o_totalprice >= 100000 GROUP BY 1")
def sorted_aggregates_decoded(spark, sf_dir):
    t = decoded_orders(spark, sf_dir).where("cents is not null").groupBy("priority")
    return t.agg(F.expr("percentile_disc(0.5) within group (order by cents)").cast("long").alias("middle"), F.max(F.col("orderkey").cast("long")).alias("last"))


# Scalar functions ------------------------------------------------------------------


@query(
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, max('{"orderkey":' || o_orderkey || ',"priority":"' || o_orderpriority || '"}') AS last_json,
    sum(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 ELSE 1 END)::BIGINT AS points FROM orders GROUP BY 1"""
)
def date_json_map_functions(spark, sf_dir):
    """Months, JSON and a lookup in a map, over decoded orders."""
    t = read(spark, sf_dir, "orders")
    value = F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), F.lit(None).cast("long").alias("cents"))
    t = packed.encode(t, value, ORDER).select("o_orderdate", F.col("encoded.payload").alias("payload"), F.col("encoded.bit_len").alias("bits"))
    t = packed.decode(t, "payload", ORDER, bit_len="bits").select("o_orderdate", "decoded.value.*")
    points = F.create_map(F.lit("1-URGENT"), F.lit(5), F.lit("2-HIGH"), F.lit(4))
    as_json = F.to_json(F.struct(F.col("orderkey").cast("long").alias("orderkey"), "priority"))
    month = F.date_format(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")), "yyyy-MM")
    return t.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max(as_json).alias("last_json"), F.sum(F.coalesce(F.try_element_at(points, F.col("priority")), F.lit(1))).alias("points"))


_ASCII16 = "upper(array_to_string(list_transform(string_split(n_name, ''), lambda x: '{}' || lpad(to_base(ascii(x), 16), 2, '0')), ''))"


@query(f"SELECT n_name AS name, {_ASCII16.format('00')} AS utf16, {_ASCII16.format('000000')} AS utf32 FROM nation")
def text_as_utf16_and_utf32(spark, sf_dir):
    node = N.text(64)
    t = packed.encode(read(spark, sf_dir, "nation"), F.col("n_name"), node).select(F.col("encoded.payload").alias("payload"))
    name = F.col("decoded.value")
    return packed.decode(t, "payload", node).select(name.alias("name"), F.hex(C.encoded_text(name, "UTF-16BE")).alias("utf16"), F.hex(C.encoded_text(name, "UTF-32")).alias("utf32"))


@query("SELECT l_orderkey, array_to_string(list_concat(v[1:3], list_transform(range(greatest(0, 3 - len(v))), lambda x: 0))::INTEGER[], ',') AS three, 12::BIGINT AS bits FROM (SELECT l_orderkey, list_sort(list(l_linenumber)) AS v FROM lineitem GROUP BY 1)")
def fixed_array_of_three(spark, sf_dir):
    """Copies of exactly three elements, cut or filled with zero, in an array of fixed size without a length."""
    node = N.buffer(4, 3, 3)
    t = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("short"))).alias("v"))
    t = packed.encode(t, C.fixed_slice(F.col("v"), 3, F.lit(0).cast("short")), node).select("l_orderkey", F.col("encoded.payload").alias("payload"), F.col("encoded.bit_len").alias("bits"))
    return packed.decode(t, "payload", node).select("l_orderkey", F.array_join(F.transform("decoded.value", lambda x: x.cast("string")), ",").alias("three"), "bits")


# Field types -----------------------------------------------------------------------

#: SQL of the value that each arm holds for a nation's key k, as a double, and the arm's bits.
_ARMS = {
    "bool": ("k % 2", 1), "u4": ("k % 16", 4), "u8": ("k * 10", 8), "i8": ("k - 12", 8), "u16": ("k * 2000", 16), "i16": ("(k - 12) * 2000", 16),
    "u32": ("k * 100000000", 32), "i32": ("(k - 12) * 100000000", 32), "u64": ("k * 1000000000000", 64), "i64": ("(k - 12) * 1000000000000", 64), "u32p8": ("k + 1", 32), "u32p16": ("k + 70000", 32),
    "u64p32": ("k * 5000000000", 64), "i32p8": ("k - 12", 32), "i32p16": ("(k - 12) * 70000", 32), "i64p32": ("(k - 12) * 5000000000", 64), "f16": ("k * 0.5", 16), "f32": ("k * 0.125 - 1", 32), "f64": ("k / 7.0e0", 64),
}


@query(
    "SELECT n_nationkey AS key, 'null' AS tag, NULL::DOUBLE AS value, 5::BIGINT AS bits FROM nation"
    + "".join(f" UNION ALL SELECT k, '{name}', ({of})::DOUBLE, {5 + bits}::BIGINT FROM (SELECT n_nationkey::BIGINT AS k FROM nation)" for name, (of, bits) in _ARMS.items())
)
def primitive_variant_arms(spark, sf_dir):
    """Every arm of the variant of all primitives, the null arm among them, with its five tag bits."""
    node = N.primitive_variant()
    t = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    kinds = {k: n.spark_type() for k, _, n in node.arms}
    tags = F.array(F.lit("null"), *map(F.lit, _ARMS))
    t = t.withColumn("tag", F.explode(tags))
    value = F.struct("tag", *(F.when(F.col("tag") == name, F.expr(of) % 2 == 1 if name == "bool" else F.expr(of).cast(kinds[name])).cast(kinds[name]).alias(name) for name, (of, _) in _ARMS.items()))
    t = packed.encode(t, value, node).select("k", F.col("encoded.payload").alias("payload"), F.col("encoded.bit_len").alias("bits"))
    v = F.col("decoded.value")
    number = F.coalesce(*(v[name].cast("int").cast("double") if name == "bool" else v[name].cast("double") for name in _ARMS))
    return packed.decode(t, "payload", node, bit_len="bits").select(F.col("k").alias("key"), v["tag"].alias("tag"), number.alias("value"), "bits")


@query("SELECT event_type = 'error' AS was_error, CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS tag, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN user_id END)::BIGINT AS users FROM events GROUP BY ALL")
def variant_set_and_make(spark, sf_dir):
    """Errors turned into views of the same user, by setting another arm."""
    t = packed.decode(events(spark, sf_dir, "user_id"), "payload", EVENT, bit_len="bit_len")
    v = F.col("decoded.value")
    t = t.withColumn("changed", C.set_arm(v, EVENT, "view", user_low(F.col("user_id")), when=C.is_arm(v, "error")))
    t = packed.encode(t, F.col("changed"), EVENT, "again").select(C.is_arm(v, "error").alias("was_error"), "block", F.col("again.payload").alias("p"))
    w = F.col("back.value")
    users = F.when(F.col("was_error"), whole_user(F.col("block"), C.get_arm(w, "view")))
    return packed.decode(t, "p", EVENT, "back").groupBy("was_error", w["tag"].alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(users).alias("users"))


@query("SELECT c_custkey, c_acctbal >= 0 AS ok, CASE WHEN c_acctbal >= 0 THEN c_nationkey END::INTEGER AS value, CASE WHEN c_acctbal >= 0 THEN c_nationkey ELSE 99 END::INTEGER AS or_else, CASE WHEN c_acctbal < 0 THEN 'ErrorOptionalValueIsEmpty' END AS error, TRUE AS empty FROM customer")
def optional_access(spark, sf_dir):
    node = N.optional(N.uint(8))
    t = packed.encode(read(spark, sf_dir, "customer"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")), node)
    o = F.col("decoded.value")
    t = packed.decode(t.withColumn("payload", F.col("encoded.payload")), "payload", node)
    got = C.try_get(o)
    return t.select("c_custkey", got["ok"].alias("ok"), got["value"].cast("int").alias("value"), C.value_or(o, F.lit(99)).cast("int").alias("or_else"), C.unwrap(o)["error"].alias("error"), C.reset(o).isNull().alias("empty"))


@query("SELECT o_orderkey, ((o_orderkey::HUGEINT + 4294967296) * 1000000000000 % 18446744073709551616)::VARCHAR AS product, CASE WHEN o_orderkey % 300 + 10 <= 255 THEN (o_orderkey % 300 + 10)::INTEGER END AS small FROM orders")
def unchecked_arithmetic(spark, sf_dir):
    """Products wrap at 64 bits; the range check of eight bits stays."""
    k = F.col("o_orderkey")
    product = C.unchecked("mul", k + 4294967296, F.lit(1000000000000), N.uint(64))
    return read(spark, sf_dir, "orders").select("o_orderkey", product["value"].cast("string").alias("product"), C.unchecked("add", k % 300, F.lit(10), N.uint(8))["value"].cast("int").alias("small"))


# Modes, bounds, validation -----------------------------------------------------------

_BITS = f"({_K.replace('l_orderkey', 'o_orderkey')} + 3 + CASE WHEN o_totalprice >= 100000 THEN 41 ELSE 1 END)"


@query(f"SELECT o_orderkey % 9 AS kept, count(*) AS n FROM orders WHERE 8 * least(o_orderkey % 9, ({_BITS} + 7) // 8) >= {_BITS} GROUP BY 1")
def mode_dropmalformed(spark, sf_dir):
    """Payloads cut to orderkey mod 9 bytes; messages that are too short are dropped."""
    t = read(spark, sf_dir, "orders")
    cents = F.when(F.col("o_totalprice") >= 100000, F.round(F.col("o_totalprice") * 100).cast("long"))
    t = packed.encode(t, F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), cents.alias("cents")), ORDER)
    t = t.select((F.col("o_orderkey") % 9).alias("kept"), F.substring(F.col("encoded.payload"), F.lit(1), (F.col("o_orderkey") % 9).cast("int")).alias("payload"))
    return packed.decode(t, "payload", ORDER, mode="DROPMALFORMED").groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def mode_failfast(spark, sf_dir):
    """A malformed message would end this query; there is none."""
    return packed.decode(orders(spark, sf_dir), "payload", ORDER, mode="FAILFAST", bit_len="bit_len").groupBy(F.col("decoded.value.priority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN ({_BITS} + 7) // 8 > 5 THEN 'ErrorInsufficentBufferSize' END AS error, count(*) AS n, sum(CASE WHEN ({_BITS} + 7) // 8 <= 5 THEN {_BITS} END)::BIGINT AS bits FROM orders GROUP BY 1")
def bounded_buffer(spark, sf_dir):
    """Messages of over five bytes don't fit."""
    t = read(spark, sf_dir, "orders")
    cents = F.when(F.col("o_totalprice") >= 100000, F.round(F.col("o_totalprice") * 100).cast("long"))
    t = packed.encode(t, F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), cents.alias("cents")), ORDER, max_bytes=5)
    return t.groupBy(F.col("encoded.error").alias("error")).agg(F.count(F.lit(1)).alias("n"), F.sum("encoded.bit_len").alias("bits"))


@query("SELECT CASE WHEN CAST(l_quantity AS INTEGER) <= 31 THEN 'Ok' ELSE 'ErrorValueOverflow' END AS code, count(*) AS n FROM lineitem GROUP BY 1")
def validate_codes(spark, sf_dir):
    return packed.validate(read(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("int"), N.uint(5)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n_nationkey AS key, ({ORDER.min_bits} + 7) // 8 + (({ORDER.max_bits} + 7) // 8 - ({ORDER.min_bits} + 7) // 8) * least(n_nationkey * 5, 100) // 100 AS bytes FROM nation")
def growable_buffer_sizes(spark, sf_dir):
    size = C.growable_bytes(F.lit(ORDER.min_bits), F.lit(ORDER.max_bits), F.col("n_nationkey") * 5)
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), size.cast("long").alias("bytes"))


@query("SELECT s_suppkey AS key, (s_suppkey % 65536)::INTEGER AS id, CAST(s_acctbal::FLOAT AS DOUBLE) AS balance FROM supplier")
def float32_column(spark, sf_dir):
    """Single-precision balances, packed and unpacked by column expressions alone."""
    node = N.obj(id=N.uint(16), balance=N.float_(8, 23))
    t = packed.encode(read(spark, sf_dir, "supplier"), F.struct((F.col("s_suppkey") % 65536).cast("int").alias("id"), F.col("s_acctbal").cast("float").alias("balance")), node)
    t = packed.decode(t.select("s_suppkey", F.col("encoded.payload").alias("payload")), "payload", node)
    return t.select(F.col("s_suppkey").alias("key"), F.col("decoded.value.id").cast("int").alias("id"), F.col("decoded.value.balance").cast("double").alias("balance"))


# Streams -----------------------------------------------------------------------------


@query(
    """SELECT strftime(w, '%Y-%m-%d %H') AS begin, user_id::INTEGER AS user, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total
    FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY ALL"""
)
def stream_sliding_decode(spark, sf_dir):
    """Windows of a day that begin every twelve hours."""
    t = windows.drained(windows.windowed(reading_stream(spark, sf_dir), "payload", READING, "ts", "user", "cents", "1 day", slide="12 hours"))
    return t.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("begin"), "user", "n", "total")
