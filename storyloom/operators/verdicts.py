"""Whether single words were misread, told by phones; and spellings that may be read better."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.types import DOUBLE, STRING, array, struct
from .alignment import ratio
from .phones import unmatched

# Weak forms of function words, accepted beside the full form.
WEAK_FORMS = {
    "and": "ənd ən", "are": "ɚ", "but": "bət", "can": "kən", "could": "kəd", "does": "dəz", "for": "fɚ", "from": "fɹəm", "had": "həd əd", "has": "həz əz", "have": "həv əv", "her": "ɚ", "him": "ɪm",
    "his": "ɪz", "our": "ɑɹ", "should": "ʃəd", "some": "səm", "that": "ðət", "their": "ðɚ", "them": "ðəm əm", "there": "ðɚ", "was": "wəz", "were": "wɚ", "would": "wəd", "your": "jɚ",
}
# Thresholds of a verdict.
FAULT, FAULT_OF_SHORT_OR_UNUSUAL, SHORT_PHONES, LEAST_PHONES, LEAST_SPAN = 0.45, 0.70, 4, 3, 0.5
# Rewritings that may lead to a better reading, in order.
RESPELLINGS = (("^wr", "r"), ("^kn", "n"), ("ph", "f"), ("ough", "ow"), ("augh", "aw"), ("x", "ks"), ("y", "i"), ("ch", "k"), ("e$", ""), ("ham$", "um"), ("shawe$", "shaw"), (r"([bcdfghjklmnpqrstvwxz])\1", r"\1"))


def positions(expected: str, heard: str) -> list[int]:
    """For each phone expected, where in ``heard`` it was said: matched phones at their match, the others spread over what was
    heard in their gap."""
    found = list(range(len(expected)))
    at = 0
    for i1, i2, j1, j2 in unmatched(expected, heard):
        for i in range(at, i1):
            found[i] = j1 - (i1 - i)
        for i in range(i1, i2):
            found[i] = j1 + (i - i1) * (j2 - j1) // (i2 - i1)
        at = i2
    return found


def placed(part: str, whole: str) -> tuple[int, int]:
    """The stretch of ``whole`` that is most like ``part`` and as long, the first of equals; nothing of an empty one."""
    if not part or not whole:
        return 0, 0
    starts = range(max(1, len(whole) - len(part) + 1))
    exact = whole.find(part)
    best = exact if exact >= 0 else max(starts, key=lambda s: (ratio(part, whole[s : s + len(part)]), -s))
    return best, best + len(part)


def word_verdict(word: str, phones: str, heard: str, unusual: bool = False) -> dict:
    """Whose fault a difference is: the reading's ('xtts'), the transcript's ('whisper'), or not to be told ('inconclusive')."""
    forms = [phones, *WEAK_FORMS.get(word.lower().strip(".,!?;:\"'()[]…—-"), "").split()]
    distance, form = min((1.0 - ratio(f, heard), f) for f in forms)
    limit = FAULT_OF_SHORT_OR_UNUSUAL if unusual or len(phones) <= SHORT_PHONES else FAULT
    if len(heard) < LEAST_SPAN * len(phones):
        source = "inconclusive"
    else:
        source = "xtts" if distance >= limit and len(phones) >= LEAST_PHONES else "whisper"
    return {"word": word, "expected_phones": form, "actual_phones": heard, "distance": round(distance, 3), "source": source}


def word_verdicts(words: list[str], phones: list[str], expected: str, heard: str) -> list[dict]:
    """Verdicts of ``words``, whose phones are given, in a text whose phones are ``expected``, against what was heard at their place."""
    if not expected or not heard:
        return []
    at, out = positions(expected, heard), []
    for word, own in zip(words, phones):
        low, high = placed(own, expected)
        if high > low:
            end = at[high - 1] + 1 if high <= len(at) else len(heard)
            out.append(word_verdict(word, own, heard[at[low] : end], len(word) > 3 and word[0].isupper()))
    return out


@F.pandas_udf(array(struct(word=STRING, expected_phones=STRING, actual_phones=STRING, distance=DOUBLE, source=STRING)))
def _verdicts(words: pd.Series, phones: pd.Series, expected: pd.Series, heard: pd.Series) -> pd.Series:
    return pd.Series([[] if any(x is None for x in row) else word_verdicts(*row) for row in zip(words, phones, expected, heard)], dtype=object)


def verdicts(words: Column, phones: Column, expected: Column, heard: Column) -> Column:
    """An array of verdicts; empty where any of the four is null."""
    return _verdicts(words, phones, expected, heard)


def respellings(word: str, most: int = 12) -> list[str]:
    """Other spellings of ``word``: by each rewriting alone and after those before it, without repeats, capitalized as the word is."""
    found: dict[str, str] = {}
    grown = word
    for pattern, to in RESPELLINGS:
        rule = re.compile(pattern, re.I)
        for base in (word, grown):
            other = rule.sub(to, base)
            other = other[:1].upper() + other[1:] if word[:1].isupper() else other
            if other and other.lower() != word.lower():
                found.setdefault(other.lower(), other)
        grown = rule.sub(to, grown)
    return list(found.values())[:most]


@F.pandas_udf(array(STRING))
def respelling_candidates(words: pd.Series) -> pd.Series:
    return words.map(respellings, na_action="ignore")
