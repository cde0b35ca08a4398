"""Windows over streams of packed messages.

Decoding keeps no state, so the operators of ``operators.packed`` take streaming
frames as they are; state exists only for the windows, bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.operators import packed
from bitquarry.schema.nodes import Node
from bitquarry.sources.stored import shared_dir


def windowed(stream: DataFrame, payload: str, node: Node, time: str, key: str, value: str, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window, key, n, total) of decoded messages: tumbling, or sliding with slide.

    key and value are fields of the decoded message, time a column of the stream.
    Malformed messages are dropped.
    """
    d = packed.decode(stream, payload, node, "__m", mode="DROPMALFORMED").withWatermark(time, late)
    m = F.col("__m")["value"]
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return d.groupBy(w.alias("window"), m[key].alias(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(m[value]).alias("total"))


def sessions(stream: DataFrame, payload: str, node: Node, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(session, key, n): runs of a key's messages without a longer gap."""
    d = packed.decode(stream, payload, node, "__m", mode="DROPMALFORMED").withWatermark(time, late)
    return d.groupBy(F.session_window(time, gap).alias("session"), F.col("__m")["value"][key].alias(key)).agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a stream has now, run to its end into stored tables.

    Each batch is written to a folder of its own by its number, so a batch that
    runs again replaces what it wrote; nothing is gathered on the driver.
    complete gives the last batch's table, append and update all batches' rows.
    The state stands in the shared folder beside them.
    """
    path, written = shared_dir(stream.sparkSession), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        written.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    numbers = sorted(set(written))
    if not numbers:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(*(f"{path}/batch-{n}" for n in (numbers[-1:] if mode == "complete" else numbers)))
