"""Takes of a reading: which are better, which to repeat, and what experiments with them show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# By how much a distance must differ to count.
MARGIN, CLIP_MARGIN = 0.06, 0.03


def regressions(shipped: DataFrame, takes: DataFrame, by: list[str], word: str = "word") -> DataFrame:
    """The rows of ``takes`` (``by``, word, distance, faulty) that a take damages: faulty now, and fine before or worse by more than the
    margin. A word that ``shipped`` doesn't have was fine."""
    before = shipped.select(*by, word, F.col("distance").alias("_was"), F.col("faulty").alias("_bad"))
    joined = takes.where("faulty").join(before, [*by, word], "left")
    return joined.where(~F.coalesce("_bad", F.lit(False)) | (F.col("distance") > F.coalesce("_was", F.lit(0.0)) + MARGIN)).drop("_was", "_bad")


def retake_reason(failed: Column, stopped_early: Column, injected: Column, round_: Column, rounds: int) -> Column:
    """Why a take is repeated, the gravest reason first; 'fallback' once the rounds are used up; null for a good one."""
    reason = F.when(failed, "failed").when(stopped_early, "early_stop").when(injected, "hallucination")
    return F.when(reason.isNotNull() & (round_ >= rounds), "fallback").otherwise(reason)


def seed(chunk: Column, attempt: Column, base: int = 999) -> Column:
    return F.lit(base) + chunk + attempt * 100003


def best_of(takes: DataFrame, target: list[str], shipped: str, distance: str, cost: str, fault: float = 0.45) -> DataFrame:
    """Per target: what was shipped, the best of its takes, whether that improves on it or rescues a fault, and what all takes cost."""
    best = takes.groupBy(*target).agg(F.max(shipped).alias("shipped"), F.min(distance).alias("best"), F.sum(cost).alias("cost"))
    return best.withColumn("improved", F.col("best") < F.col("shipped")).withColumn("rescued", (F.col("shipped") >= fault) & (F.col("best") < fault))


def sweep(results: DataFrame, setting: list[str], shipped: str, distance: str) -> DataFrame:
    """Per setting of a parameter sweep: how many targets became better, worse or stayed, and the mean change."""
    change = F.col(distance) - F.col(shipped)
    return results.groupBy(*setting).agg(F.count_if(change < 0).alias("better"), F.count_if(change > 0).alias("worse"), F.count_if(change == 0).alias("same"), F.round(F.avg(change), 6).alias("mean_change"))


def trigger_rates(hits: DataFrame, variant: list[str], repeat: str, position: str, severity: str) -> DataFrame:
    """Per variant of a text: repeats, those with any hit, those with one near the end (position above 0.7), the worst severity."""
    each = hits.groupBy(*variant, repeat).agg((F.count(position) > 0).alias("_any"), F.coalesce(F.max(F.col(position) > 0.7), F.lit(False)).alias("_end"), F.max(severity).alias("_worst"))
    return each.groupBy(*variant).agg(F.count("*").alias("repeats"), F.count_if("_any").alias("any_hits"), F.count_if("_end").alias("end_hits"), F.max("_worst").alias("worst"))


def clean_pass(takes: DataFrame, target: list[str], attempt: str, severity: str, shipped: str) -> DataFrame:
    """Per target the first take without findings (severity 0), else the mildest if it is milder than what was shipped, else none:
    attempt (null: kept), cleaned."""
    picked = takes.groupBy(*target).agg(F.min(F.when(F.col(severity) == 0, F.col(attempt))).alias("_clean"), F.min(F.when(F.col(severity) < F.col(shipped), F.struct(severity, attempt))).alias("_milder"))
    return picked.select(*target, F.coalesce("_clean", F.col("_milder")[attempt]).alias("attempt"), F.col("_clean").isNotNull().alias("cleaned"))


def improved(before: Column, after: Column) -> Column:
    return after < before - CLIP_MARGIN
