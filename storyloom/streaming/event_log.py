"""The event log and jobs as streams. The checkpoint is the cursor; availableNow is one tick of a scheduler."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.events import EVENT


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a growing folder of JSON lines; unreadable lines are skipped."""
    lines = spark.readStream.text(folder)
    return lines.select(F.from_json("value", EVENT).alias("e")).select("e.*").where("id is not null").withColumn("at", F.to_timestamp("ts"))


def counts_by_window(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by type and window of their own time; later than ``late`` they no longer count, so state is bounded."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "type").count().select(F.col("window.start").alias("start"), "type", "count")


def unique_events(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def latest_by_key(events: DataFrame, keys: list[str], ttl_ms: int = 600_000) -> DataFrame:
    """The latest event of each key, emitted whenever it changes; a key unseen for ``ttl_ms`` of the events' own time is forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (-1, "")
        for b in batches:
            row = b.loc[b["id"].idxmax()]
            if row["id"] > held[0]:
                held = (int(row["id"]), row["type"])
        state.update(held)
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + ttl_ms)
        yield pd.DataFrame([(*key, *held)], columns=[*keys, "id", "type"])

    fields = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return events.withWatermark("at", "0 seconds").groupBy(*keys).applyInPandasWithState(step, f"{fields}, id long, type string", "id long, type string", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """One tick: everything new since the checkpoint, written as parquet."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
