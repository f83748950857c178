"""Rates, histograms, choices and joins over findings, takes and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import keep_first, numbered, ranged


def percent(done: Column, total: Column) -> Column:
    """100·done/total; 0 if there is nothing."""
    return F.when(total > 0, 100.0 * done / total).otherwise(0.0)


def issue_rates(findings: DataFrame, chunks: DataFrame, chapter: list[str], chunk: str = "chunk") -> DataFrame:
    """Per chapter and in all (null chapter columns, is_total): chunks, findings, bad chunks — with any finding — and the rate in per cent.

    Findings are cut down to one row a chunk before they meet the inventory; chunks and findings of chunks not in it are ignored.
    """
    keys = [*chapter, chunk]
    per_chunk = findings.groupBy(*keys).agg(F.count("*").alias("_f"))
    all_ = chunks.select(*keys).distinct().join(per_chunk, keys, "left")
    totals = all_.groupingSets([[F.col(c) for c in chapter], []], *chapter).agg(F.grouping_id().alias("_g"), F.count("*").alias("chunks"), F.coalesce(F.sum("_f"), F.lit(0)).alias("findings"), F.count_if(F.col("_f").isNotNull()).alias("bad_chunks"))
    return totals.select(*chapter, (F.col("_g") > 0).alias("is_total"), "chunks", "findings", "bad_chunks", F.round(percent(F.col("bad_chunks"), F.col("chunks")), 2).alias("rate"))


def cause_histogram(findings: DataFrame, by: str, causes: str = "causes") -> DataFrame:
    """(``by``, cause, n); a row without causes counts as '(none)'."""
    return findings.select(by, F.explode_outer(causes).alias("cause")).groupBy(by, F.coalesce("cause", F.lit("(none)")).alias("cause")).agg(F.count("*").alias("n"))


def confidence_tier(length: Column, corroborated: Column, reliable: Column) -> Column:
    """How sure injected audio is: long or corroborated runs first, then by what the text lets one trust."""
    return F.when((length >= 10) | corroborated, "confirmed").when(~reliable, "probable_fp").when(length >= 8, "confirmed").when(length >= 6, "likely").otherwise("borderline")


def reliable_text(text: Column) -> Column:
    """No letter three times running, no capitals of three or more, no chain of hyphens."""
    return ~(text.rlike(r"([A-Za-z])\1\1") | text.rlike(r"(?U)\b[A-Z]{3,}\b") | text.rlike(r"(?U)\w-\w+-\w"))


def pace(df: DataFrame, by: list[str], rate: str, letters: str, least_letters: int) -> DataFrame:
    """Median, 99th centile (the value at ⌊0.99 n⌋ from 0, no interpolation), greatest and recalibrated (× 1.1) rates of long enough rows.

    Rows are counted by value before a group's values are put in order, so a group of many rows is as many as its distinct rates.
    """
    long = df.where((F.col(letters) >= least_letters) & F.col(rate).isNotNull())
    w = Window.partitionBy(*by)
    ranked = long.groupBy(*by, rate).agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(w.orderBy(rate))).withColumn("_n", F.sum("_c").over(w))
    at = lambda k: F.min(F.when(F.col("_upto") > F.floor(k), F.col(rate)))
    low, high, n = at((F.col("_n") - 1) / 2), at(F.col("_n") / 2), F.col("_n")
    p99 = at(F.least(n - 1, F.floor(n * 99 / 100)))
    return ranked.groupBy(*by).agg(F.max("_n").alias("chunks"), ((low + high) / 2).alias("median"), p99.alias("p99"), F.max(rate).alias("greatest")).withColumn("recalibrated", F.col("greatest") * 1.1)


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def paired(df: DataFrame, by: list[str], control: str, fix: str) -> DataFrame:
    """Hits with and without a fix, how far they fall in per cent, and how many hit rows the fix clears."""
    c, f = F.sum(control), F.sum(fix)
    return df.groupBy(*by).agg(F.count("*").alias("n"), c.alias("control_hits"), f.alias("fix_hits"), F.count_if((F.col(control) > 0) & (F.col(fix) == 0)).alias("cleared")).withColumn("reduction", F.when(F.col("control_hits") > 0, 100.0 * (F.col("control_hits") - F.col("fix_hits")) / F.col("control_hits")))


def best_take(takes: DataFrame, target: list[str]) -> DataFrame:
    """The first clean take of each target, else the one of least (shortfall, severity), the earliest of equals."""
    return keep_first(takes, target, [F.when(F.col("clean"), F.col("attempt")).asc_nulls_last(), F.coalesce("shortfall", F.lit(0.0)), "severity", "attempt"])


def keep_take(broke: Column, shipped_stray: Column, take_stray: Column, shipped_distance: Column, take_distance: Column, margin: float = 0.06) -> Column:
    """Whether a take replaces what was shipped: never with a broken word; a shorter stray wins, a longer one loses; else the distance must fall by more than the margin."""
    return F.when(broke > 0, False).when(take_stray != shipped_stray, take_stray < shipped_stray).otherwise(shipped_distance - take_distance > margin)


def collisions(df: DataFrame, key: str, item: str) -> DataFrame:
    """Keys claimed by more than one distinct item, with their number and the least and greatest of them."""
    return df.groupBy(key).agg(F.count_distinct(item).alias("n"), F.min(item).alias("first_item"), F.max(item).alias("last_item")).where("n > 1")


def owner_as_of(df: DataFrame, owners: DataFrame, by: list[str], at: str, start: str, owner: str) -> DataFrame:
    """``df`` with the owner of the greatest ``start`` below ``at`` within ``by``; null if there is none.

    Rows and owners are merged into one order, cut into ranges and written. Each range carries the last owner forward by
    itself, from the last one of the ranges before it, of which there is one row a range; so a ``by`` of many rows is many tasks.
    """
    cols = df.columns
    rows = df.select("*", F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(owners.schema[owner].dataType).alias("_owner"))
    marks = owners.select(*by, F.col(start).alias("_at"), F.lit(1).alias("_kind"), F.col(owner).alias("_owner"))
    merged = ranged(rows.unionByName(marks, allowMissingColumns=True), [*by, "_at", "_kind"])
    order = Window.partitionBy(*by, "_p").orderBy("_at", "_kind", "_owner").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = merged.groupBy(*by, "_p").agg(F.max_by("_owner", F.when(F.col("_kind") == 1, F.struct("_at", "_owner"))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*(F.col(c).alias(f"_c_{c}") for c in by), F.col("_p").alias("_q"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    same = F.col("_p") == F.col("_q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    owned = merged.withColumn("_own", F.last("_owner", ignorenulls=True).over(order)).where("_kind = 0").join(carried, same, "left")
    return owned.withColumn(owner, F.coalesce("_own", "_carried")).select(*dict.fromkeys([*cols, owner]))


def merged_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of either side with ``side``: both, left or right. Columns of equal names keep the left value unless it is null."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared}).withColumn("_right", F.lit(True))
    j = left.withColumn("_left", F.lit(True)).join(r, keys, "full_outer")
    side = F.when(F.col("_left") & F.col("_right"), "both").when(F.col("_left"), "left").otherwise("right")
    return j.withColumns({c: F.coalesce(c, f"_r_{c}") for c in shared}).withColumn("side", side).drop("_left", "_right", *(f"_r_{c}" for c in shared))


def worst_match(findings: DataFrame, faults: DataFrame, keys: list[str]) -> DataFrame:
    """``findings`` (with finding_id, expected) and the fault (word, distance) of greatest distance among the words they name."""
    words = findings.select("finding_id", *keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("expected"), F.lit("([a-z0-9]+(?:'[a-z]+)?)"), F.lit(1)))).alias("word"))
    worst = words.join(faults.select(*keys, F.lower("word").alias("word"), "distance"), [*keys, "word"]).groupBy("finding_id").agg(F.max_by("word", F.struct("distance", "word")).alias("fault_word"), F.max("distance").alias("fault_distance"))
    return findings.join(worst, "finding_id", "left")


def length_batches(df: DataFrame, key: str, length: str, budget: int) -> DataFrame:
    """Rows, the longest first, in batches whose padded size — rows times the longest — stays within ``budget``: (.., batch).

    By powers of two: rows of a length class fill batches of ⌊budget / class bound⌋ rows. Rows are numbered within their class by ranges,
    so that no class is walked in one task. A row longer than the budget is a batch by itself; a null length counts as 1.
    """
    bound = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col(length), F.lit(1))))).cast("long")
    d = df.withColumn("_b", bound).withColumn("_cap", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_b")))).withColumn("_neg", -F.coalesce(length, F.lit(0)))
    n = numbered(d, ["_neg", key], "_k", start=0, within=["_b"])
    return n.withColumn("batch", F.concat_ws("-", F.col("_b"), F.floor(F.col("_k") / F.col("_cap")))).drop("_b", "_cap", "_neg", "_k")
