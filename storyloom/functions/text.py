"""Text functions as Catalyst expressions. Null stays null in all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Unicode (property White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def where_has(c: Column, signs: list[str], f: Callable[[Column], Column]) -> Column:
    """``f`` of the texts that hold one of ``signs``; others as they are. ``c`` is evaluated once, however such steps are chained."""

    def step(x: Column) -> Column:
        holds = F.contains(x, F.lit(signs[0]))
        for sign in signs[1:]:
            holds = holds | F.contains(x, F.lit(sign))
        return F.when(holds, f(x)).otherwise(x)

    return F.get(F.transform(F.array(c), step), F.lit(0))


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def slug(c: Column) -> Column:
    """Lower case, every stretch of anything but letters and digits a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def object_key(series: Column, book: Column, chapter: Column, suffix: str = "mp3") -> Column:
    """A key whose text order is the numeric order: slug/book-002/chapter-00013.mp3."""
    return F.concat(slug(series), F.lit("/book-"), F.lpad(book.cast("string"), 3, "0"), F.lit("/chapter-"), F.lpad(chapter.cast("string"), 5, "0"), F.lit("." + suffix))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[ .]+$", "")


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def metadata_escape(c: Column) -> Column:
    """For key=value chapter files: = ; # \\ and line feeds are escaped."""
    return F.regexp_replace(c, r"([=;#\\\n])", r"\\$1")


def strip_leading_notes(c: Column) -> Column:
    """Without the bracketed asides and bare chapter numbers that lead a text, however they alternate."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^(?:\s*\[[^\]]*\]\s*|\s*\d+\.?[ \t]*(?:\n|\z))++", ""), r"^\n+", "")


def scene_breaks(c: Column) -> Column:
    """Rows of stars, dashes or underscores and rules become a blank line."""
    for signs, pattern in (
        (["\\*"], r"(?U)\s*(?:\\\*){3,}\s*"), (["***"], r"(?U)\s*\*{3,}\s*"), (["---"], r"(?U)\s*-{3,}\s*"), (["___"], r"(?U)\s*_{3,}\s*"), (["*"], r"(?U)\s*(?:\*\s+){2,}\*\s*"), (["<"], r"(?i)<hr(?U:\s)*/?>"),
    ):
        c = where_has(c, signs, lambda x, p=pattern: F.regexp_replace(x, p, "\n\n"))
    return c


def whitespace(c: Column) -> Column:
    """Tabs are spaces, runs of spaces one, blank lines at most one."""
    c = F.regexp_replace(F.regexp_replace(c, "[\t ]+", " "), "\n{3,}", "\n\n")
    return strip(c)


def comparable(c: Column) -> Column:
    """The form in which an expected text and a heard one are compared: lower case, no marks, hyphens as spaces."""
    c = F.regexp_replace(collapse(F.lower(c)), "[\"'‘’“”*_()]", "")
    c = F.regexp_replace(c, r"([a-z])\.\s*([a-z])\.", "$1$2")
    c = F.regexp_replace(F.regexp_replace(c, "[.:;,!?]+", " "), "([a-z]+)-([a-z]+)", "$1 $2")
    return collapse(F.regexp_replace(c, r"(?U)[^\w\s]", ""))


def paragraphs(c: Column) -> Column:
    """The paragraphs between blank lines, trimmed; empty ones are left out."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def marked_sentences(c: Column) -> Column:
    """Sentences that end in . ! or ? before white space: the plain split used for reports."""
    return F.split(c, r"(?U)(?<=[.!?])\s+")


def block_key(lines: Column) -> Column:
    """12 hexadecimal digits that name a block of lines whatever their indentation."""
    return F.substring(F.sha2(F.array_join(F.transform(lines, strip), "\n"), 256), 1, 12)


def is_generic_title(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*chapter\s+\d+\s*$")


def context_around(c: Column, offset: Column, width: int = 40) -> Column:
    """The text from ``width`` characters before ``offset`` to ``width`` behind it, white space collapsed."""
    low = F.greatest(offset - width, F.lit(0))
    return collapse(F.substring(c, low + 1, offset + width - low))
