"""Numbers in words as Catalyst expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ((1_000_000_000, " billion"), (1_000_000, " million"), (1_000, " thousand"), (1, ""))
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def _words(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _below_hundred(n: Column) -> Column:
    ten = F.get(_words(TENS), F.floor(n / 10).cast("int"))
    rest = (n % 10).cast("int")
    return F.when(n < 20, F.get(_words(ONES), n.cast("int"))).when(rest == 0, ten).otherwise(F.concat_ws("-", ten, F.get(_words(ONES), rest)))


def _below_thousand(n: Column) -> Column:
    hundreds = F.when(n >= 100, F.concat(F.get(_words(ONES), F.floor(n / 100).cast("int")), F.lit(" hundred")))
    return F.concat_ws(" ", hundreds, F.when(n % 100 > 0, _below_hundred(n % 100)))


def number_words(n: Column) -> Column:
    """A whole number from 0 below 10**12 in words ('one hundred seventy-six thousand'); larger ones and negative ones in digits. Null stays null."""
    n = n.cast("long")
    groups = [F.when(g > 0, F.concat(_below_thousand(g), F.lit(name))) for size, name in SCALES for g in [F.floor(n / size) % 1000]]
    return F.when((n >= 10**12) | (n < 0), n.cast("string")).when(n == 0, F.lit("zero")).when(n > 0, F.concat_ws(" ", *groups))


def ordinal_suffix(n: Column) -> Column:
    """'1st', '2nd', '3rd', '11th'. Null stays null."""
    n = n.cast("long")
    teen = (n % 100).between(10, 20)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def ordinal_words(n: Column) -> Column:
    """'forty-second': the last word is inflected. Null stays null."""
    w = number_words(n)
    last = F.regexp_extract(w, "([a-z]+)$", 1)
    head = F.substring(w, F.lit(1), F.char_length(w) - F.char_length(last))
    irregular = F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv))
    return F.concat(head, F.coalesce(F.try_element_at(irregular, last), F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))), F.concat(last, F.lit("th"))))


def year_words(year: Column) -> Column:
    """1872 → 'eighteen seventy-two', 1905 → 'nineteen oh five', 2007 → 'two thousand seven', 1900 → 'nineteen hundred'."""
    y = year.cast("int")
    century, rest = number_words(F.floor(y / 100)), y % 100
    return F.when(y.between(2000, 2009), number_words(y)).when(rest == 0, F.concat(century, F.lit(" hundred"))).when(rest < 10, F.concat(century, F.lit(" oh "), number_words(rest))).otherwise(F.concat_ws(" ", century, number_words(rest)))
