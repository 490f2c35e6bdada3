"""Event streams: windowed counts with a watermark, from files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).option("pathGlobFilter", pattern).parquet(folder)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window; state older than the watermark is dropped. Works on static tables too."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events with no longer gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def user_totals(events: DataFrame, idle: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, n, total, closed) of a stream, in update mode: what each user has had so far, once per batch with events of
    theirs; closed, for the last time, once the watermark is ``idle`` past their last event, when their state is dropped."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    gap = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, batches, state):
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "closed": [True]})
            return
        for b in batches:
            n, total, last = n + len(b), total + float(b["value"].sum()), max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + gap)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "closed": [False]})

    e = events.withWatermark("ts", late).select("user_id", "ts", "value")
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double, closed boolean", "n long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout)


def latest(events: DataFrame, spark: SparkSession, checkpoint: str, table: str) -> None:
    """Runs a stream to the end of what is there, each batch appended to a table under its own checkpoint."""
    events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table).awaitTermination()
