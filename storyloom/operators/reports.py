"""Small reports over findings, chapters and stored artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Scores of tiers, phones a second, marks.
TIER_SCORES = {"confirmed": 0.90, "likely": 0.70, "borderline": 0.45, "probable_fp": 0.20}
OTHER_SCORE, PHONES_A_SECOND, STRETCHED, MARK = 0.30, 13.0, 1.45, " ⟨▓⟩"
SKIPPED = "(Interface reference — see the text version.)"


def tier_histogram(df: DataFrame, tier: str = "tier") -> DataFrame:
    """(tier, n, share, kept): how many there are of each tier, in per cent of all, and whether the tier is kept (all but probable_fp)."""
    counts = df.groupBy(tier).agg(F.count("*").alias("n"))
    total = df.select(F.count("*")).scalar()
    return counts.select(F.col(tier).alias("tier"), "n", F.round(100.0 * F.col("n") / total, 2).alias("share"), (F.col(tier) != "probable_fp").alias("kept"))


def confidence_score(tier: Column, corroborated: Column, length: Column) -> Column:
    base = F.coalesce(*(F.when(tier == t, F.lit(s)) for t, s in TIER_SCORES.items()), F.lit(OTHER_SCORE))
    return F.round(F.least(F.lit(0.99), base + F.when(corroborated, 0.06).otherwise(0.0) + 0.005 * F.least(F.coalesce(length, F.lit(0)), F.lit(12))), 3)


def marked_at(text: Column, position: Column) -> Column:
    """``text`` with a mark at the first word boundary from the share ``position`` on; at the end if 12 characters or fewer are left. Null
    positions leave it as it is."""
    bare = F.regexp_replace(text, r"(?U)\s+\z", "")
    size = F.char_length(bare)
    at = F.greatest(F.lit(0), F.least(size, F.floor(position * size).cast("int")))
    behind = F.substring(bare, at + 1, size)
    blank = F.instr(behind, " ")
    cut = at + blank - 1
    inside = F.concat(F.substring(bare, F.lit(1), cut), F.lit(MARK), F.substring(bare, cut + 1, size))
    return F.when(position.isNull(), text).when((blank == 0) | (size - at <= 12), F.concat(bare, F.lit(MARK))).otherwise(inside)


def residual_bucket(position: Column, text: Column) -> Column:
    """Where what a fix left over lies: trailing proper noun, chunk-end, chunk-start or mid-chunk."""
    at = F.coalesce(position, F.lit(0.0))
    last = F.regexp_replace(F.element_at(F.split(strip(text), r"(?U)\s+"), -1), "^[.,!?\"'’”]+|[.,!?\"'’”]+$", "")
    return F.when((at >= 0.8) & last.rlike(r"^\p{Lu}"), "trailing proper noun").when(at >= 0.85, "chunk-end").when(at <= 0.2, "chunk-start").otherwise("mid-chunk")


def duration_ratio(seconds: Column, phones: Column) -> Column:
    """How much longer the audio is than its phones warrant; null without either."""
    return F.when((seconds > 0) & (phones > 0), F.round(seconds / (phones / PHONES_A_SECOND), 2))


def top_findings(findings: DataFrame, floor: float, limit: int, key: str = "finding_id") -> DataFrame:
    """The ``limit`` most severe findings at or above the floor; early stops need not reach it. Ties are broken by ``key``."""
    kept = findings.where((F.col("severity") >= floor) | (F.col("kind") == "early_stop"))
    return kept.orderBy(F.desc_nulls_last("severity"), key).limit(limit)


def stratified_pick(df: DataFrame, first: Column, second: Column, order: list, limit: int) -> DataFrame:
    """A third of ``limit`` of the rows for which ``first`` holds, the rest of those for which ``second`` does, each by ``order``; stratum 1 or 2."""
    part = max(1, limit // 3)
    a = df.where(first).orderBy(*order).limit(part).withColumn("stratum", F.lit(1))
    return a.unionByName(df.where(second & ~F.coalesce(first, F.lit(False))).orderBy(*order).limit(limit - part).withColumn("stratum", F.lit(2)))


def series_summary(df: DataFrame, series: str, book: str, at: str) -> DataFrame:
    """Per series the first and last date, books, chapters, and the list of (book, chapters): chapters are counted by book first."""
    per = df.groupBy(series, book).agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    return per.groupBy(series).agg(F.min("a").alias("first_at"), F.max("b").alias("last_at"), F.count(book).alias("books"), F.sum("n").alias("chapters"), F.array_sort(F.collect_list(F.struct(book, "n"))).alias("by_book"))


def renumbered(df: DataFrame, owner: list[str], order: list[str], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*owner).orderBy(*order)))


def by_position(local: DataFrame, source: DataFrame, owner: list[str], number: str, order: list[str]) -> DataFrame:
    """``local`` with what ``source`` has at the same place: its rows are numbered from 1 within ``owner``; unmatched rows stay, with nulls."""
    return local.join(renumbered(source, owner, order, number), [*owner, number], "left")


def stale_outputs(recorded: DataFrame, present: DataFrame, output: list[str], item: str) -> DataFrame:
    """(``output``, stale): whether an output's recorded items (``item``, size) differ from those present in number, name or size. An output
    with no items present isn't stale; one never recorded is."""
    r = recorded.select(*output, item, F.col("size").alias("_was"), F.lit(True).alias("_r"))
    p = present.select(*output, item, F.col("size").alias("_is"), F.lit(True).alias("_p"))
    differs = F.col("_r").isNull() | F.col("_p").isNull() | ~F.col("_was").eqNullSafe(F.col("_is"))
    return r.join(p, [*output, item], "full_outer").groupBy(*output).agg((F.max(differs) & (F.count("_p") > 0)).alias("stale"))


def not_yet(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose keys ``done`` doesn't have: what to download, compute or upload; null keys count as not done."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def upload_reason(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """(key, reason): missing, size, content, or null if equal. Tags of several parts, with a hyphen, only let sizes be compared."""
    r = remote.select(key, F.col("size").alias("_size"), F.col("etag").alias("_tag"), F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("size") != F.col("_size"), "size").when(~F.col("_tag").contains("-") & (F.col("md5") != F.col("_tag")), "content")
    return local.join(r, key, "left").select(key, reason.alias("reason"))


def uniform(df: DataFrame, owner: list[str], form: list[str]) -> DataFrame:
    """(``owner``, uniform): whether all rows have one form; a null counts as a value."""
    one = F.struct(*form)
    return df.groupBy(*owner).agg((F.min(F.to_json(one)) == F.max(F.to_json(one))).alias("uniform"))


def largest(df: DataFrame, owner: list[str], item: str, size: str) -> DataFrame:
    """The item of greatest size, of equals the one that sorts last."""
    return df.groupBy(*owner).agg(F.max_by(item, F.struct(size, item)).alias(item))


def chapter_marks(df: DataFrame, owner: list[str], order: str, title: Column, start_s: str, end_s: str) -> DataFrame:
    """Marks of one file as text, in thousandths of a second; bounded by the chapters of a book."""
    one = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.round(F.col(start_s) * 1000).cast("long"), F.lit("\nEND="), F.round(F.col(end_s) * 1000).cast("long"), F.lit("\ntitle="), title)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), one.alias("_x"))))
    return df.groupBy(*owner).agg(F.array_join(F.transform(lines, lambda x: x["_x"]), "\n").alias("marks"))


def rendered_fields(fields: Column, form: str = "summary") -> Column:
    """What is said for a specification block's (label, value) pairs: 'summary' names its shape, 'labels' its labels; those without values don't count."""
    labels = F.transform(F.filter(fields, lambda f: (f["value"] != "") & (f["label"] != "")), lambda f: f["label"])
    n = F.size(labels)
    summary = F.concat(F.lit("The profile lists "), n, F.lit(" fields, from "), F.get(labels, F.lit(0)), F.lit(" to "), F.get(labels, n - 1), F.lit("."))
    listed = F.concat(F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(labels, n - 1), F.lit("."))
    return F.when(n == 0, SKIPPED).otherwise(summary) if form == "summary" else F.when(n < 2, SKIPPED).otherwise(listed)


def pinned(blocks: DataFrame, renderings: DataFrame, strict: bool = False) -> DataFrame:
    """``blocks`` (block_key, ..) with the pinned ``rendering`` (key, rendering) of each; unmatched ones are null, or raise an error if ``strict``."""
    joined = blocks.join(renderings.select(F.col("key").alias("block_key"), "rendering"), "block_key", "left")
    return joined.withColumn("rendering", F.coalesce("rendering", F.raise_error(F.concat(F.lit("no rendering for "), F.col("block_key"))).cast("string"))) if strict else joined


def first_defect_of_word(findings: DataFrame, by: list[str], key: str = "finding_id") -> DataFrame:
    """Per ``by`` and word of ``expected``, the most severe finding that names it; ties go to the lower ``key``."""
    words = findings.select(*by, key, "severity", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("expected"), F.lit("([a-z0-9]+(?:'[a-z]+)?)"), F.lit(1)))).alias("word"))
    return words.groupBy(*by, "word").agg(F.min_by(key, F.struct((-F.coalesce("severity", F.lit(0.0))).alias("s"), F.col(key).alias("k"))).alias(key))


def sentence_with(text: Column, word: Column, width: int = 80) -> Column:
    """The first sentence that holds the word, whatever its case, else the text's first ``width`` characters."""
    found = F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), F.lower(word)))
    return F.coalesce(F.get(found, F.lit(0)), F.substring(text, 1, width))
