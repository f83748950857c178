"""The append-only event log: JSON lines read with a cursor, and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import numbered

EVENT = "id long, ts string, type string, fiction_id string, book int, chapter int, severity string, detail string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; lines that can't be parsed, or have no id, are skipped. ``detail`` stays JSON; severity defaults to info."""
    lines = spark.read.text(path).select(F.from_json("value", EVENT).alias("e"), "value")
    return lines.select("e.*").where("id is not null").withColumn("severity", F.coalesce("severity", F.lit("info")))


def events_since(events: DataFrame, since: int, limit: int | None = None, kind: str | None = None, order: str = "id") -> DataFrame:
    """Events behind the cursor ``since``, the first ``limit`` of them by id."""
    df = events.where(F.col(order) > since)
    df = df.where(F.col("type") == kind) if kind else df
    return df.orderBy(order).limit(limit) if limit else df


def append_events(events: DataFrame, log: DataFrame | None, path: str) -> None:
    """Writes new events, whose ids go on from the log's last; for one writer at a time."""
    last = (log.agg(F.max("id")).first()[0] if log is not None else None) or 0
    numbered(events, ["ts"], "id", last + 1).write.mode("append").json(path)
