"""Text made ready to be spoken: a fixed order of steps, each of which can be called alone.

Steps that only replace patterns are Catalyst expressions, each of which uses its input once; notices, initialisms and figures
need Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import in_words, spell_initialisms
from .figures import dates, numbers
from .notices import SITES, notices_of

# Abbreviations and what is said for them.
ABBREVIATIONS = {"U.S.": "United States", "U.K.": "United Kingdom", "Mr.": "Mister", "Mrs.": "Misses", "Dr.": "Doctor", "vs.": "versus", "etc.": "etcetera"}
# Units of time and play that a stroke makes 'per'.
PER = "week|year|day|month|match|game"

_SHORT = re.compile(r"(?m)\b(" + "|".join(map(re.escape, ABBREVIATIONS)) + r")(?!\w)([ \t]*$)?")
_ANY_DIGIT = re.compile(r"\d")
_TIME = re.compile(r"(\d+)\s+([ap])(?:\.m\.|m)(?!\w)", re.I)


def punctuation(c: Column) -> Column:
    """Dashes, ellipses, repeated marks and emphasis; '2 > 4' as a rise, '/week' as 'per week', other strokes as spaces."""
    for signs, pattern, to in (
        (["--"], r"(?U)--(?<=\w--)(?=\w)", "—"), (["--"], r"(?U)\s--\s", " — "), (["..."], r"\.{3,}", "…"), (["!!", "??"], r"([!?])\1+", "$1"),
        (["*"], r"\*\*([^*]+)\*\*|\*([^*\n]+)\*", "$1$2"), (["_"], r"(?U)__([^_]+)__|\b_([^_]+)_\b", "$1$2"), ([">"], r"(?U)(?<=[\d%)])\s*>\s*(?=[£$€\d])", ", rising to "),
        (["/"], rf"(?iU)/\s*({PER})\b", " per $1"), (["/"], r"(?U)(?<=\w)\s*/\s*(?=\w)", " "),
    ):
        c = T.where_has(c, signs, lambda x, p=pattern, t=to: F.regexp_replace(x, p, t))
    return F.replace(c, F.lit("*"), F.lit(""))


def lexicon(text: str, respelling: dict[str, str]) -> str:
    """Whole words, whatever their case, by the lexicon's spelling; longer entries first."""
    if not respelling:
        return text
    by = {k.lower(): v for k, v in respelling.items()}
    words = "|".join(map(re.escape, sorted(by, key=len, reverse=True)))
    return re.sub(rf"\b(?:{words})\b", lambda m: by[m[0].lower()], text, flags=re.I)


def acronyms(text: str) -> str:
    """Abbreviations in full; one at the end of its line keeps a full stop. Then initialisms are spelled."""
    full = _SHORT.sub(lambda m: ABBREVIATIONS[m[1]] + ("" if m[2] is None else "." + m[2]), text)
    return spell_initialisms(full)


def times(text: str) -> str:
    return _TIME.sub(lambda m: f"{in_words(int(m[1]))} {m[2].upper()} M", text)


def spoken(text: str) -> str:
    """The steps on words and figures: abbreviations and initialisms, times of day, dates, numbers."""
    text = acronyms(text)
    return numbers(dates(times(text))) if _ANY_DIGIT.search(text) else text


def _by_text(c: Column, f: Callable[[str], str]) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run(c)


def _notices(c: Column, sites: tuple[str, ...]) -> Column:
    gone = _by_text(c, lambda t: notices_of(sites).without(t))
    return F.regexp_replace(F.regexp_replace(gone, "\n{3,}", "\n\n"), " {2,}", " ")


#: The steps by name, in the order in which they apply.
STEPS: dict[str, Callable[[Column], Column]] = {
    "strip_leading_notes": T.strip_leading_notes,
    "normalize_scene_breaks": T.scene_breaks,
    "remove_notices": lambda c: _notices(c, SITES),
    "normalize_punctuation": punctuation,
    "normalize_acronyms": lambda c: _by_text(c, acronyms),
    "normalize_time_formats": lambda c: _by_text(c, times),
    "normalize_dates": lambda c: _by_text(c, dates),
    "normalize_numbers": lambda c: _by_text(c, numbers),
    "normalize_whitespace": T.whitespace,
}


def normalized(text: Column, step: Column | None = None, respelling: dict[str, str] | None = None, sites: tuple[str, ...] = SITES) -> Column:
    """``text`` ready to be spoken, or after the one step that ``step`` names (an unknown name gives null). Null stays null.

    The steps apply in the order of STEPS; the lexicon, if any, before punctuation. ``sites``: those whose notices are removed.
    """
    if step is not None:
        steps = {**STEPS, "remove_notices": lambda c: _notices(c, tuple(sites))}
        return F.coalesce(*(F.when(step == name, f(F.when(step == name, text))) for name, f in steps.items()))
    c = _notices(T.scene_breaks(T.strip_leading_notes(text)), tuple(sites))
    if respelling:
        c = _by_text(c, lambda t: lexicon(t, respelling))
    return T.whitespace(_by_text(punctuation(c), spoken))


def normalize_texts(df: DataFrame, text: str, respelling: dict[str, str] | None = None, sites: tuple[str, ...] = SITES) -> DataFrame:
    """``df`` with ``text`` normalized; all rows and columns stay."""
    return df.withColumn(text, normalized(F.col(text), None, respelling, sites))
