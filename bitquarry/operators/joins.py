"""Joins by order: as-of and range joins that no hot key can gather in one task.

Both cut the ordered axis into buckets of a width that the caller knows, and
meet by key and bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, width: int, prefix: str = "last_") -> DataFrame:
    """left with the columns of the latest right row of its key at or before it (null where there is none).

    at is a whole number in both; of right rows at the same place the one with
    the largest other columns counts, in their order.  Null keys and places match
    nothing.  Rows meet in windows of a key and a bucket; what was last before a
    bucket comes from one row for each key and bucket.
    """
    others = [c for c in right.columns if c not in (by, at)]
    bucket = F.floor(F.col(at) / width)
    fact = F.struct(F.col(at).alias("at"), *others)
    l = left.select(F.col(by).alias("_by"), bucket.alias("_bucket"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_row"))
    r = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_by"), bucket.alias("_bucket"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), fact.alias("_fact"))
    # The last fact of each key and bucket, and from these the last one before each bucket that has left rows.
    tails = r.groupBy("_by", "_bucket").agg(F.max("_fact").alias("_tail"))
    slots = tails.unionByName(l.select("_by", "_bucket").distinct(), allowMissingColumns=True).groupBy("_by", "_bucket").agg(F.max("_tail").alias("_tail"))
    earlier = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("_by", "_bucket", F.last("_tail", ignorenulls=True).over(earlier).alias("_before")).where("_before is not null")
    own = Window.partitionBy("_by", "_bucket").orderBy("_at", "_kind", "_fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = l.unionByName(r, allowMissingColumns=True).withColumn("_fact", F.last("_fact", ignorenulls=True).over(own)).where("_kind = 1")
    met = met.join(carried, ["_by", "_bucket"], "left").withColumn("_fact", F.when(F.col("_by").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_fact", "_before")))
    return met.select("_row.*", *(F.col("_fact")[c].alias(f"{prefix}{c}") for c in ["at", *others]))


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: int, by: str | None = None) -> DataFrame:
    """Rows of points and ranges where low <= at <= high (and the key agrees), numbers all; null places match nothing.

    A range stands in each bucket that it touches, so width should be near the
    usual range; a point stands in one.  The join is by key and bucket, and
    Spark's skew join splits the points of a hot one.
    """
    keys = ["_bucket", *([by] if by else [])]
    p = points.where(F.col(at).isNotNull()).withColumn("_bucket", F.floor(F.col(at) / width))
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, keys).where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")
