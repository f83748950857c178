"""Figures in running text, put into words.

The text is scanned once for runs of digits. Each run is read together with what touches it — a currency sign, groups,
a fraction, a scale, a suffix — and the first reading that its surroundings allow decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.words import in_words, ordinal, spoken_year

# What may touch a figure.
CURRENCIES = {"£": "pounds", "$": "dollars", "€": "euros"}
SCALES = {"k": 3, "thousand": 3, "m": 6, "million": 6, "b": 9, "bn": 9, "billion": 9}
SCALE_NAMES = {3: "thousand", 6: "million", 9: "billion"}
UNITS = (
    "kg kgs kilo kilos kilogram kilograms gram grams lb lbs pound pounds ton tons tonne tonnes stone km kms kilometer kilometers kilometre kilometres meter meters metre metres cm mm "
    "mile miles yard yards yds feet foot ft inch inches litre litres liter liters ml mph kph percent"
).split()
COUNTED = "points votes goals fans people supporters matches games players tickets".split()
COUNT_CUES = ("a total of", "score of", "got")
MONTHS = "January February March April May June July August September October November December".split()

_RUN = re.compile(r"\d+")
_SCALE_AFTER_SUM = re.compile(r"\s*(k|m|bn|thousand|million|billion)\b")
_SCALE_AFTER_DECIMAL = re.compile(r"(k|m|bn)\b")
_UNIT_NEXT = re.compile(rf"\s*(?:%|(?:{'|'.join(UNITS)})\b)", re.I)
_COUNTED_NEXT = re.compile(rf"\s+(?:{'|'.join(COUNTED)})\b", re.I)
_MONTH = rf"({'|'.join([*MONTHS, *(m[:3] for m in MONTHS if m != 'May'), 'Sept'])})\.?"
_DAY, _YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", r"(1[1-9]\d\d|20\d\d)\b(?![,.]\d)"
_DAY_FIRST = re.compile(rf"\b{_DAY}(?:\s+of)?\s+{_MONTH},?\s+{_YEAR}")
_MONTH_FIRST = re.compile(rf"\b{_MONTH}\s+{_DAY}\b,?\s+{_YEAR}")


def scaled(whole: str, fraction: str, scale: str) -> str:
    """A sum in words. A fraction of two digits or more with a scale is multiplied out where that is exact, else read digit by digit."""
    power = SCALES.get(scale.lower(), 0)
    if power and len(fraction) > 1:
        number = whole + fraction + "0" * power
        if not number[len(number) - len(fraction) :].strip("0"):
            return in_words(int(number[: len(number) - len(fraction)]))
    spoken = [in_words(int(whole))]
    if fraction:
        spoken += ["point", *(in_words(int(d)) for d in fraction)]
    return " ".join([*spoken, SCALE_NAMES[power]] if power else spoken)


class Figure:
    """One run of digits at ``start`` to ``end`` of ``text``; a reading is (from, to, words) or None."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.digits = text[start:end]
        self.before = text[start - 1 : start]
        self.opens = not self._in_word(start - 1)

    def _in_word(self, i: int) -> bool:
        c = self.text[i] if 0 <= i < len(self.text) else ""
        return c == "_" or c.isalnum()

    def _digits_end(self, i: int) -> int:
        m = _RUN.match(self.text, i)
        return m.end() if m else i

    def _groups_end(self) -> int:
        """Behind the groups of three that follow commas."""
        i = self.end
        while self.text[i : i + 1] == "," and self._digits_end(i + 1) == i + 4 and (not self._in_word(i + 4) or self.text[i + 4].isdigit()):
            i += 4
        return i

    def _fraction_end(self, i: int) -> int:
        return self._digits_end(i + 1) if self.text[i : i + 1] == "." else i

    def age(self) -> tuple | None:
        return (self.start, self.end, in_words(int(self.digits))) if self.text.startswith("-year-old", self.end) else None

    def nth(self) -> tuple | None:
        fits = self.opens and len(self.digits) < 3 and self.text[self.end : self.end + 2] in ("st", "nd", "rd", "th") and not self._in_word(self.end + 2)
        return (self.start, self.end + 2, ordinal(int(self.digits))) if fits else None

    def amount(self) -> tuple | None:
        sign = self.start - 1
        if self.before.isspace():
            sign -= 1
        name = CURRENCIES.get(self.text[sign : sign + 1]) if sign >= 0 else None
        if not name:
            return None
        groups = self._groups_end()
        for whole in (groups, self.end) if groups > self.end else (groups,):
            for end in dict.fromkeys((self._fraction_end(whole), whole)):
                if end == whole + 1:
                    continue
                scale = _SCALE_AFTER_SUM.match(self.text, end)
                if scale or not self._in_word(end):
                    words = scaled(self.text[self.start : whole].replace(",", ""), self.text[whole + 1 : end], scale[1] if scale else "")
                    return sign, scale.end() if scale else end, f"{words} {name}"
        return None

    def decimal(self) -> tuple | None:
        end = self._fraction_end(self.end)
        if not self.opens or end <= self.end + 1:
            return None
        if self.text.startswith("-year-old", end):
            return None  # the digits behind the point are an age
        scale = _SCALE_AFTER_DECIMAL.match(self.text, end)
        if scale is None and self._in_word(end):
            return None
        return self.start, scale.end() if scale else end, scaled(self.digits, self.text[self.end + 1 : end], scale[1] if scale else "")

    def year(self) -> tuple | None:
        fits = self.opens and len(self.digits) == 4 and (1100 <= int(self.digits) <= 1999 or 2000 <= int(self.digits) <= 2099) and self.before not in (",", ".")
        if not fits or self._in_word(self.end) or self.text[self.end : self.end + 1] in (",", ".") and self._digits_end(self.end + 1) > self.end + 1 or _UNIT_NEXT.match(self.text, self.end):
            return None
        lead = self.text[max(0, self.start - 20) : self.start]
        cue = lead.rstrip().lower()
        told = lead != lead.rstrip() and any(cue.endswith(c) and not cue[: -len(c)][-1:].isalnum() for c in COUNT_CUES)
        n = int(self.digits)
        return self.start, self.end, in_words(n) if told or _COUNTED_NEXT.match(self.text, self.end) else spoken_year(n)

    def compound(self) -> tuple | None:
        behind = self.text[self.end + 1 : self.end + 2]
        fits = self.opens and self.before not in (",", ".", "-") and self.text[self.end : self.end + 1] == "-" and behind.isascii() and behind.isalpha()
        return (self.start, self.end, in_words(int(self.digits))) if fits else None

    def grouped(self) -> tuple | None:
        end = self._groups_end()
        if end > self.end and self._fraction_end(end) > end + 1:
            end -= 4  # the last group begins a decimal
        if not self.opens or len(self.digits) > 3 or end == self.end or self._in_word(end):
            return None
        n = int(self.text[self.start : end].replace(",", ""))
        return self.start, end, in_words(n) if n >= 100 else self.text[self.start : end]

    def plain(self) -> tuple | None:
        fits = self.opens and len(self.digits) > 2 and not self._in_word(self.end) and int(self.digits) >= 100
        return (self.start, self.end, in_words(int(self.digits))) if fits else None


_READINGS: tuple[Callable[[Figure], tuple | None], ...] = (Figure.age, Figure.amount, Figure.nth, Figure.decimal, Figure.year, Figure.compound, Figure.grouped, Figure.plain)


def numbers(text: str) -> str:
    """Ages, amounts, ordinals, decimals, years, compounds and large numbers in words; other figures stay as written."""
    out: list[str] = []
    done = at = 0
    while m := _RUN.search(text, at):
        figure = Figure(text, m.start(), m.end())
        start, at, words = next((r for reading in _READINGS if (r := reading(figure))), (m.start(), m.end(), None))
        if words is not None:
            out += [text[done:start], words]
            done = at
    return "".join([*out, text[done:]])


def dates(text: str) -> str:
    """Full dates in words, in their own order; a day beyond 31 is left as written."""

    def said(m: re.Match, day: str, month: str, year: str, form: str) -> str:
        if not 0 < int(day) < 32:
            return m[0]
        name = next(x for x in MONTHS if x.startswith(month[:3]))
        return form.format(ordinal(int(day)), name, spoken_year(int(year)))

    text = _DAY_FIRST.sub(lambda m: said(m, *m.groups(), "{} of {}, {}"), text)
    return _MONTH_FIRST.sub(lambda m: said(m, m[2], m[1], m[3], "{1} {0}, {2}"), text)
