"""Samples of bounded size that depend on the rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of ``df`` whose ``column`` has one of about ``most`` of its distinct values, chosen by hash; all if it has no more.

    Sent to the driver only as much as is kept: no task orders or returns more than its share.
    """
    distinct = df.agg(F.approx_count_distinct(column).alias("n")).first()["n"]
    share = min(1.0, most / max(1, distinct))
    return df.where(F.pmod(F.xxhash64(column), F.lit(1 << 40)) < int(share * (1 << 40)))


def sample_of_bytes(df: DataFrame, text: str, kind: Column, most: int) -> list[str]:
    """Whole distinct texts of each ``kind`` (null: none), of about ``most`` characters a kind, chosen by hash and in order.

    Texts longer than a tenth of ``most`` are left out of the sample, so that its size is bounded whatever the texts.
    """
    fit = df.where(F.col(text).isNotNull() & (F.char_length(text) <= most // 10))
    place = F.pmod(F.xxhash64(text), F.lit(1 << 40))
    shares = {r["_kind"]: min(1.0, most / max(1, r["n"])) for r in fit.groupBy(kind.alias("_kind")).agg(F.sum(F.char_length(text)).alias("n")).collect() if r["_kind"] is not None}
    if not shares:
        return []
    wanted = fit.where(place < int(max(shares.values()) * (1 << 40))).withColumn("_kind", kind)
    kept = wanted.where(place < F.coalesce(*(F.when(F.col("_kind") == k, F.lit(int(s * (1 << 40)))) for k, s in shares.items()), F.lit(0)))
    return sorted({r[0] for r in kept.select(text).collect()})
