"""What an author says around a chapter: post titles, sign-offs and notes behind the story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# How a sign-off reads, and how chunks begin that are no story; a space is any white space.
SIGN_OFF = r"Thanks\s+for\s+your\s+su[po]+[rt]+!?"
NOTE_OPENINGS = (
    r"SCHEDULING NOTE", r"Next\s*(?:chapter|:)", r"Probably (?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day", r"I'm on", r"If you want to play", r"That will be the end of", r"Book \d+ was ",
    r"How not to", r"Max's inspiration", r"Please note", r"Copy paste", r"Go to the", r"Thanks to \w+ for", r"A real-life", r"More about", r"Here'?s? a link", r"Check out", r"A new Discord link", r"If anyone has any ideas",
)
POST_TITLE = r"^(?:([A-Za-z]{1,10})\s+)?(\d+)\.(\d+)\s*-\s*(.+?)(?:\s*\[.*\])?$"

_OPENING = "(?i)^(?:" + "|".join([SIGN_OFF, *(p.replace(" ", r"\s+") for p in NOTE_OPENINGS)]) + ")"


def without_trailing_notes(text: Column) -> Column:
    """The text up to a line of dots alone, or up to a sign-off at the beginning of a line; it ends in one line feed. Null stays null."""
    for end in (r"(?s)\n\s*…+\s*\n.*$", r"(?s)\n\s*\.\s*\n.*$", rf"(?is)\n\s*{SIGN_OFF}.*$"):
        text = F.regexp_replace(text, end, "")
    return F.concat(F.regexp_replace(text, r"(?U)\s+\z", ""), F.lit("\n"))


def is_note(text: Column) -> Column:
    """Whether a chunk is no story at all; an empty one is a note, a null one isn't told (null)."""
    bare = strip(text)
    return (bare == "") | bare.rlike(_OPENING)


def story_chunks(df: DataFrame, chapter: list[str], chunk: str, text: str) -> DataFrame:
    """``df`` with ``kept``: whether a chunk is story. What follows a chapter's first sign-off isn't, nor are the notes at the end of what is left.

    Two small aggregates a chapter, joined back; no chapter is sorted. A null text counts as story; rows of null chunk number aren't kept.
    """
    note, ends = F.coalesce(is_note(F.col(text)), F.lit(False)), F.coalesce(F.col(text).rlike(f"(?i){SIGN_OFF}"), F.lit(False))
    told = df.select(*chapter, F.col(chunk).alias("_at"), note.alias("_note"), ends.alias("_ends"))
    first = told.groupBy(*chapter).agg(F.min(F.when(F.col("_ends"), F.col("_at"))).alias("_first"))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in chapter]
    a, b = told.alias("a"), first.alias("b")
    left = a.join(b, same(told, first)).where("not _note and (_first is null or _at <= _first)").groupBy(*(F.col(f"a.{c}").alias(c) for c in chapter)).agg(F.max("_at").alias("_last"))
    joined = df.join(left, same(df, left), "left").drop(*(left[c] for c in chapter))
    return joined.withColumn("kept", F.coalesce(F.col(chunk) <= F.col("_last"), F.lit(False))).drop("_last")


def post_title(title: Column, offsets: dict[str, int] | None = None) -> Column:
    """A struct (series, book, chapter, title) of a chapter post's title; null for other posts. A series' offset is added to its book."""
    bare = strip(title)
    part = lambda n: F.regexp_extract(bare, POST_TITLE, n)
    shift = F.coalesce(*(F.when(part(1) == s, F.lit(n)) for s, n in (offsets or {}).items()), F.lit(0))
    fields = F.struct(F.nullif(part(1), F.lit("")).alias("series"), (part(2).try_cast("int") + shift).alias("book"), part(3).try_cast("int").alias("chapter"), strip(part(4)).alias("title"))
    return F.when(bare.rlike(POST_TITLE), fields)
