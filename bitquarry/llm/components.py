"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.llm.tables import cut


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u > v): every neighbour is tied to the smallest one.

    The minimum is aggregated before the shuffle; the join back may meet a hot
    centre, whose rows the skew join splits.
    """
    both = links.select("u", "v")
    if large:
        both = both.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    tied = both.join(least, both.u == least.c)
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links (u > v) are stars: each u once, and no v is a u."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups > 1 or ups = 1 and downs = 1").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link table (a long, b long); root is the smallest node reachable.

    Links to the node itself and null ends are ignored; an empty table gives no
    rows.  Each round is written to the shared folder.  It ends when all links
    are stars, after a number of rounds that grows with the logarithm of the
    longest path.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = cut(_stars(_stars(now, True), False))
    raise RuntimeError("the components did not settle")
