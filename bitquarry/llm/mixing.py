"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its share by weight, stopped at
``most`` times what it has, the excess shared again by weight.  In a source a
document of size z should be taken m times, m = min(most, c * w(z)); w falls
slowly with the document's length class and c makes the expected words meet the
target.  floor(m) copies are certain; for the rest f = m - floor(m) is the
chance of one more.  Documents are ranked by Pareto's order key, the odds of a
random number over the odds of f, and taken from the smallest until the words
of the certain copies and of these reach the target.

Random numbers come from a hash of the id, so reruns agree.  A source is never
gathered in one task: a count of words by key bucket finds the bucket in which
the target is met, a second one splits that bucket, and only the rows of the
last bucket are ranked.  Nor are the sources: those are sorted over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.llm.tables import checked, cut

WORD = r"[^\x20\x09-\x0D]+"
_BUCKETS = 1024


def words(text: Column) -> Column:
    """Runs of bytes other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sorted(df: DataFrame, *order: Column) -> DataFrame:
    """df sorted over all tasks and written, with the number of each row's part and its place in there."""
    place = F.monotonically_increasing_id()
    df = df.orderBy(*order).select("*", place.alias("place"))
    return cut(df.select(*(c for c in df.columns if c != "place"), F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))


def _water_level(stops: DataFrame) -> float:
    """The level at which sum(least(level * weight, stop)) of rows (source_size, weight, stop, ratio) is sum(source_size).

    Ratios (stop / weight) are sorted over all tasks.  The driver sees three sums
    of each part, finds the part in which the level lies, and reads one row of it.
    """
    by = _sorted(stops.groupBy("ratio").agg(F.sum("stop").alias("stop"), F.sum("weight").alias("weight"), F.sum("source_size").alias("size")), F.col("ratio"))
    parts = by.groupBy("part").agg(F.sum("stop").alias("stop"), F.sum("weight").alias("weight"), F.sum("size").alias("size"), F.max(F.struct("ratio", "stop", "weight")).alias("last")).orderBy("part").collect()
    total, above = float(sum(p["size"] for p in parts)), sum(p["weight"] for p in parts)
    below = 0.0
    for p in parts:
        last = p["last"]
        if (total - (below + p["stop"] - last["stop"])) / (above - p["weight"] + last["weight"]) <= last["ratio"]:
            order = Window.partitionBy("part").orderBy("ratio")
            before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
            level = (F.lit(total - below) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.lit(above - p["weight"]) + F.sum("weight").over(after))
            return by.where(F.col("part") == p["part"]).select("ratio", level.alias("level")).where("level <= ratio").agg(F.max("level").alias("level")).first()["level"]
        below += p["stop"]
        above -= p["weight"]
    return float("inf")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources by code point, null last, have the weights in turn.  Targets are
    weight times one level, stopped at most * size; the level makes their sum
    that of the sizes.  No task sees all sources: they are sorted over all tasks,
    and the driver holds a few sums of each part.  Sources without any size have
    the target zero; an empty table gives no rows.
    """
    s = _sorted(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    begin, at = {}, 0
    for p in s.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        begin[p["part"]], at = at % len(weights), at + p["n"]
    first = F.element_at(F.create_map(*(F.lit(x) for pair in begin.items() for x in pair)), F.col("part")) if begin else F.lit(0)
    turn = F.pmod(F.col("row") + first, F.lit(len(weights))).cast("int")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("stop", F.lit(most) * F.col("source_size"))
    level = _water_level(s.withColumn("ratio", F.col("stop") / F.col("weight")))
    return s.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("stop")).alias("target"))


def class_rates(classes: DataFrame, most: float, damping: float) -> DataFrame:
    """classes with a rate such that min(most, rate) words times the class sizes sum to the target.

    classes: (k, length_class, size, target, ...); classes stop in the order of
    their weights damping / (damping + class), the shortest first.  A source has
    64 classes at most.
    """
    c = classes.withColumn("w", F.lit(damping) / (F.lit(damping) + F.col("length_class")))
    by = Window.partitionBy("k").orderBy("length_class")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - F.coalesce(F.sum(F.lit(most) * F.col("size")).over(before), F.lit(0.0))
    c = c.withColumn("level", F.try_divide(F.greatest(left, F.lit(0.0)), F.sum(F.col("w") * F.col("size")).over(after)))
    level = F.max(F.when(F.col("level") * F.col("w") <= most, F.col("level"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rate = F.when(level.isNotNull(), F.least(level * F.col("w"), F.lit(most))).otherwise(F.lit(most))
    return c.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0))).drop("w", "level")


def uniform(key: Column, salt: str) -> Column:
    """In (0, 1), from 52 bits of the MD5 of the salt and the key as text."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def take(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, damping: float = 16.0, salt: str = "mix", split: bool = True) -> DataFrame:
    """Rows (id, source, size) with source_size, target and taken.

    The sampled document at which a source's target is met is cut there; without
    ``split`` it is taken whole if that comes nearer to the target.  Null sources
    are one source.  Rows without words are taken zero times.  Repeated ids (null
    ids among them) have equal keys and follow each other by size.  An empty
    table gives no rows.

    The rows are read four times and meet only small written tables: a row for
    each source and length class, then one for each source, broadcast where
    their size allows (``checked``).
    """
    # A key that is never null: "1" and the name, or "0".
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = sizes.withColumn("k", key).withColumn("length_class", F.length(F.bin("size")))
    classes = cut(rows.groupBy("k", "source", "length_class").agg(F.sum("size").alias("size")))
    targets = source_targets(classes.select("source", "size"), weights, most).withColumn("k", key).drop("source")
    facts = class_rates(classes.drop("source").join(targets, "k"), most, damping)
    certain = F.sum(F.floor("rate") * F.col("size")).over(Window.partitionBy("k"))
    facts = cut(facts.withColumn("need", F.col("target") - certain).drop("size"))

    def keyed(by: DataFrame) -> DataFrame:
        """The rows with their facts, Pareto's order key and its cell."""
        r = rows.join(checked(by), ["k", "length_class"])
        r = r.withColumn("whole", F.floor("rate")).withColumn("f", F.col("rate") - F.col("whole"))
        u = uniform(F.col("id"), salt)
        r = r.withColumn("order_key", F.when(F.col("f") * F.col("size") > 0, (u / (F.lit(1.0) - u)) / (F.col("f") / (F.lit(1.0) - F.col("f")))))
        # x / (1 + x) keeps the order in [0, 1): the coarse and the fine bucket.
        place = F.col("order_key") / (F.lit(1.0) + F.col("order_key"))
        cell = F.least(F.floor(place * float(_BUCKETS * _BUCKETS)), F.lit(_BUCKETS * _BUCKETS - 1)).cast("long")
        return r.withColumn("cell", cell).withColumn("coarse", F.floor(F.col("cell") / _BUCKETS))

    def crossing(counts: DataFrame, bucket: str) -> DataFrame:
        """The bucket of each source in which need is met, and what is needed in it, of rows (k, bucket, size, need)."""
        upto = Window.partitionBy("k").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        c = counts.withColumn("upto", F.sum("size").over(upto))
        hit = c.where(F.col("upto") >= F.col("need")).groupBy("k").agg(F.min(F.struct(bucket, "upto", "size", "need")).alias("x"))
        return cut(hit.select("k", F.col(f"x.{bucket}").alias(bucket), (F.col("x.need") - (F.col("x.upto") - F.col("x.size"))).alias("need")))

    sampled = keyed(facts).where(F.col("cell").isNotNull())
    coarse = crossing(sampled.groupBy("k", "coarse").agg(F.sum("size").alias("size"), F.first("need").alias("need")), "coarse")
    fine = crossing(sampled.drop("need").join(checked(coarse), ["k", "coarse"]).groupBy("k", "cell").agg(F.sum("size").alias("size"), F.first("need").alias("need")), "cell")
    r = keyed(cut(facts.drop("need").join(fine.select("k", F.col("cell").alias("met_cell"), F.col("need").alias("met_need")), "k", "left")))
    met = F.coalesce(F.col("cell") == F.col("met_cell"), F.lit(False))
    early = r.where(~met).withColumn("extra", F.when(F.col("cell").isNotNull() & (F.col("met_cell").isNull() | (F.col("cell") < F.col("met_cell"))), F.col("size")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("k", "cell").orderBy("order_key", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    here = r.where(met).withColumn("left", F.col("met_need") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0.0), F.least(F.round("left"), F.col("size").cast("double"))).cast("long")
    if not split:
        part = F.when(F.col("left") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)).cast("long")
    here = here.withColumn("extra", part).drop("left")
    out = early.select(*here.columns).unionByName(here)
    return out.withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each document; see take().

    Texts are read once: the sizes are written to the shared folder and used from
    there.  Null and empty texts have no words; see take() for ties, null and
    repeated ids, null sources and empty tables.  Other columns play no part.
    """
    sizes = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    return take(cut(sizes), **how).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")
