"""Ordered operators: running values, runs, segments and keep-first choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def increasing_times(time: Column, partition: list[str], order: list[str]) -> Column:
    """Times made strictly increasing: one that isn't later than its forerunner is a second later than that. Exact for whole seconds."""
    w = Window.partitionBy(*partition).orderBy(*order)
    n = F.row_number().over(w)
    seconds = F.unix_seconds(time.cast("timestamp"))
    return F.timestamp_seconds(F.max(seconds - n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + n)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key: the first by ``order``, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_seen_number(df: DataFrame, owner: list[str], group: list[str], order: str, name: str) -> DataFrame:
    """``group`` numbered from 1 within ``owner`` by where it first occurs: at most one row a group is ordered."""
    firsts = df.groupBy(*owner, *group).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(*owner).orderBy("_first")
    return df.join(firsts.withColumn(name, F.dense_rank().over(w)).drop("_first"), [*owner, *group])


def segments(df: DataFrame, owner: list[str], order: list[str], number: str, mode: str = "restart") -> DataFrame:
    """A column ``segment`` from 1. restart: a 1 behind a greater number opens one; literal: every 1 but the first row does."""
    w = Window.partitionBy(*owner).orderBy(*order)
    opens = (F.col(number) == 1) & ((F.lag(number).over(w) > 1) if mode == "restart" else (F.row_number().over(w) > 1))
    return df.withColumn("_o", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("segment", 1 + F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_o")


def offsets(length: str, owner: list[str], order: list[str]) -> tuple[Column, Column]:
    """(start, end) of each row when rows lie one after another; a null length takes no room."""
    w = Window.partitionBy(*owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.coalesce(F.col(length), F.lit(0))).over(w)
    return end - F.coalesce(F.col(length), F.lit(0)), end


def limiter_gain(df: DataFrame, owner: list[str], order: str, gain: str, half: int) -> DataFrame:
    """``smoothed``: the centred moving average, over ``half`` rows to either side, of the centred sliding minimum; 1 beyond the edges."""
    w = Window.partitionBy(*owner).orderBy(order)
    around = w.rowsBetween(-half, half)
    low = df.withColumn("_low", F.least(F.lit(1.0), F.min(gain).over(around)))
    inside = F.count("*").over(around)
    return low.withColumn("smoothed", (F.sum("_low").over(around) + (2 * half + 1 - inside)) / (2 * half + 1)).drop("_low")


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in ranges of a global order, written, with a column ``_p`` that numbers them. The bounds come from a sample that is another one
    at each run, so the ranges are cut once."""
    return written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str], name: str = "n", start: int = 1, within: list[str] | None = None) -> DataFrame:
    """``df`` numbered from ``start`` in a global order, or in that of each ``within``, without bringing a group's rows into one task.

    Rows are sorted by ranges, each range is numbered by itself, and the ranges' sizes — a row for each range and group that
    it holds — shift the rest. Of rows that are equal in ``order``, any may come first.
    """
    groups = within or []
    parts = ranged(df, [*groups, *order])
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*groups, "_p").count().select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_p").alias("_q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    same = F.col("_p") == F.col("_q")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    w = Window.partitionBy(*groups, "_p").orderBy(*order)
    return parts.withColumn(name, F.row_number().over(w)).join(sizes, same).withColumn(name, (F.col(name) + F.col("_shift") + (start - 1)).cast("long")).select(*dict.fromkeys([*df.columns, name]))
