"""Linkage of records as they arrive, and event-time aggregation, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.blocking import key_pairs


def new_pairs(arriving: DataFrame, reference_keys: DataFrame, *, max_refs: int = 50, max_pairs: int = 5000) -> DataFrame:
    """Capped key blocks of one batch of record keys against all reference keys (country, uid, kt, key)."""
    columns = ["country", "uid", "src", "kt", "key"]
    both = reference_keys.withColumn("src", F.lit(1)).select(*columns).unionByName(arriving.where("src <> 1").select(*columns))
    return key_pairs(both, max_refs=max_refs, max_pairs=max_pairs)


def link_stream(keys: DataFrame, reference_keys: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **caps) -> StreamingQuery:
    """Blocks every micro-batch of a stream of record keys and hands its pairs to ``sink`` with the batch number.

    The number makes a repeated batch recognisable, so a sink that overwrites by it is exactly-once.
    """
    return keys.writeStream.foreachBatch(lambda df, n: sink(new_pairs(df, reference_keys, **caps), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a value by type and event-time window; rows later than ``late`` behind the newest are left out of finished windows.

    Works on a stream and on a table alike; ts is a timestamp.
    """
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
