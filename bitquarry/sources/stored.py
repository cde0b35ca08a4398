"""Tables stored between steps, and broadcasts behind a count."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast.
MOST_BROADCAST = 50_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share.

    Only in one process (a local master, as in tests) may that setting be absent:
    a local temporary folder is set as the checkpoint folder then.  Elsewhere
    each executor would write to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bitquarry-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/bitquarry-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written once as Parquet in the shared folder and read again.

    Later steps start from these files, so a lost executor costs the re-read of
    its splits, not a recomputation; the reader gets the exact schema.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A stored table of few columns, to be broadcast if it has at most ``most`` rows; else Spark shuffles it.

    The rows are counted from the files' footers.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
