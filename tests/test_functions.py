from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import numbers as N
from storyloom.functions import text as T
from storyloom.functions import words as W


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_numbers_in_words_agree_with_the_row_wise_twin(spark):
    r = random.Random(1)
    values = [0, 7, 13, 20, 42, 100, 101, 999, 1000, 1100, 999_999, 4_163_432, 10**9, 10**12 - 1] + [r.randrange(10 ** r.randrange(1, 13)) for _ in range(300)]
    assert column(spark, values, "long", N.number_words) == [W.in_words(v) for v in values]
    assert column(spark, values, "long", N.ordinal_words) == [W.ordinal(v) for v in values]
    assert column(spark, [10**12, -3, None], "long", N.number_words) == ["1000000000000", "-3", None]


@pytest.mark.parametrize(("year", "spoken"), [(1872, "eighteen seventy-two"), (1905, "nineteen oh five"), (2007, "two thousand seven"), (2019, "twenty nineteen"), (1900, "nineteen hundred")])
def test_years(spark, year, spoken):
    assert column(spark, [year], "int", N.year_words) == [spoken] and W.spoken_year(year) == spoken


def test_suffixes(spark):
    assert column(spark, [1, 2, 3, 4, 11, 12, 13, 21, 111, None], "int", N.ordinal_suffix) == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th", None]


def test_text_functions(spark):
    assert column(spark, ["\xa0 a  b\n", "", None], "string", T.collapse) == ["a b", "", None]
    assert column(spark, ["Élan & Co. 2", "--", None], "string", T.slug) == ["lan-co-2", "", None]
    assert column(spark, ["[note]\n14.\n[again] Then [kept] 3.", "Only"], "string", T.strip_leading_notes) == ["Then [kept] 3.", "Only"]
    assert column(spark, ["a\n***\nb\n* * *\nc<hr/>d"], "string", T.scene_breaks) == ["a\n\nb\n\nc\n\nd"]
    assert column(spark, ["“Don't,” said U.S. Marshal-man (quietly)!"], "string", T.comparable) == ["dont said us marshal man quietly"]
    assert column(spark, ["a\n\n \n\n b \n \nc", " ", None], "string", T.paragraphs) == [["a", "b", "c"], [], None]
    assert column(spark, ["a < b & 'c'"], "string", T.xml_escape) == ["a &lt; b &amp; &apos;c&apos;"]


@pytest.mark.parametrize(
    ("words", "value", "end"),
    [("one thirty six", 1, 1), ("thirty six", 36, 2), ("two hundred fifty", 250, 3), ("thousand", None, 0), ("four million one hundred sixty three thousand two", 4_163_002, 8), ("250 more", 250, 1), ("zero one", 0, 1), ("nineteen oh", 19, 1), ("two hundred hundred", 200, 2), ("twenty thirty", 20, 1)],
)
def test_cardinals(words, value, end):
    assert W.read_cardinal(words.split(), 0) == (value, end)


@pytest.mark.parametrize(("text", "spoken"), [("the FA met", "the F. A. met"), ("CEOs", "C. E. O's"), ("TO BE OK", "TO BE OK"), ("Henry VIII", "Henry VIII"), ("HMM, BBC.", "HMM, B. B. C."), ("I'LL do NOT", "I'LL do NOT"), ("ASAP!", "A. S. A. P!")])
def test_initialisms(text, spoken):
    assert W.spell_initialisms(text) == spoken
