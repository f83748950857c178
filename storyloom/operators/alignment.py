"""Alignment of expected text with what was heard, and the defects it shows.

The matcher is the standard library's (Ratcliff–Obershelp) with its junk heuristic off; its arguments come in the order
(expected, heard), for it isn't symmetric.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import BOOLEAN, DOUBLE, INT, STRING, array, struct
from ..functions.text import comparable
from ..functions.words import STOPWORDS, read_cardinal, tokens

#: Spoken names of single letters.
LETTER_NAMES = {
    "a": "ay eh", "b": "bee", "c": "see sea cee", "d": "dee", "e": "ee", "f": "ef eff", "g": "gee", "i": "eye aye", "j": "jay", "k": "kay", "l": "el ell", "m": "em",
    "n": "en", "o": "oh owe", "p": "pee", "q": "cue queue", "r": "are", "s": "es ess", "t": "tee tea", "u": "you yew", "v": "vee", "x": "ex", "y": "why", "z": "zee zed",
}
# What makes a word stylized or joined.
_STRETCHED = re.compile(r"(.)\1{2,}")
_JOINED = re.compile(r"[a-z]{2,}[-–—/][a-z]{2,}", re.I)
#: Characters from either edge of a text within which a word counts as at its boundary.
EDGE = 3


def ratio(a, b) -> float:  # noqa: ANN001
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(DOUBLE)
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2·M/T of two texts by characters, 1 for two empty ones; null if either is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def compared(expected: Column, heard: Column, threshold: float = 0.9) -> Column:
    """A struct (similarity, passed, missing, extra): how alike the comparable forms are and which words differ, in order."""
    a, b = comparable(expected), comparable(heard)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    similarity = seq_ratio(a, b)
    return F.struct(similarity.alias("similarity"), (similarity >= threshold).alias("passed"), F.slice(F.array_sort(F.array_except(words(a), words(b))), 1, 5).alias("missing"), F.slice(F.array_sort(F.array_except(words(b), words(a))), 1, 5).alias("extra"))


def _canonical(words: list[dict]) -> list[dict]:
    """Number runs as one word '#value', with the lowest probability and the whole span of time."""
    norms, out, i = [w["norm"] for w in words], [], 0
    while i < len(words):
        value, j = read_cardinal(norms, i)
        if value is None:
            out.append(words[i])
            i += 1
            continue
        run = words[i:j]
        p = [w["p"] for w in run if w["p"] is not None]
        out.append({"norm": f"#{value}", "text": " ".join(w["text"] for w in run), "at": run[0]["at"], "start": run[0]["start"], "end": run[-1]["end"], "p": min(p, default=None)})
        i = j
    return out


def _causes(word: dict, length: int) -> list[str]:
    text = word["text"]
    edge = word["at"] <= EDGE or word["at"] + len(text) >= length - EDGE
    tests = (
        ("number", any(c.isdigit() for c in text)),
        ("stylized_elongation", bool(_STRETCHED.search(text))),
        ("smushed", bool(_JOINED.search(text))),
        ("unusual_word", not edge and len(text) > 3 and text[0].isupper()),
        ("chunk_boundary", edge),
    )
    return [name for name, holds in tests if holds]


def _sounds(a: str, b: str) -> float:
    """Distance of two words, 0 to 1, by their characters; no phonetic code is used."""
    return 1.0 - ratio(a, b)


def defects(expected: str, heard: list[dict], segments: list[dict] | None = None) -> list[dict]:
    """Defects of a reading, the most severe first: kind, expected, heard, severity, causes, audio_start, audio_end, context.

    ``heard``: words with word, start, end and probability. Substitutions of equally many words are told word by word; others
    as a group. Omissions need a content word; what was heard beyond the text is ignored. Segments of low log-probability (< −1)
    or high compression (> 2.4) are defects unless a word's defect begins at the same tenth of a second.
    """
    exp = _canonical([{"norm": n, "text": t, "at": at, "start": None, "end": None, "p": None} for t, n, at in tokens(expected)])
    got = []
    for w in heard:
        if found := tokens(w.get("word") or ""):
            got.append({"norm": found[0][1], "text": found[0][0], "at": 0, "start": w.get("start"), "end": w.get("end"), "p": w.get("probability")})
    got = _canonical(got)
    size, out = len(expected), []

    def add(kind: str, words: list[dict], said: str, severity: float, causes: list[str], start: float | None, end: float | None, at: int) -> None:
        context = " ".join(expected[max(0, at - 40) : at + 40].split())
        out.append({"kind": kind, "expected": " ".join(w["text"] for w in words), "heard": said, "severity": severity, "causes": causes, "audio_start": start, "audio_end": end, "context": context})

    def substituted(a: list[dict], b: list[dict], doubt: float) -> None:
        if len(a) == len(b) == 1:
            word, said = a[0]["norm"], b[0]["norm"]
            if said in LETTER_NAMES.get(word, "").split():
                return
            causes = _causes(a[0], size)
        else:
            word, said = "".join(w["norm"] for w in a), "".join(w["norm"] for w in b)
            causes = sorted({c for w in a for c in _causes(w, size)})
        distance = _sounds(word, said)
        if distance > 0 or doubt >= 0.2:
            start = next((w["start"] for w in b if w["start"] is not None), None)
            end = next((w["end"] for w in reversed(b) if w["end"] is not None), None)
            add("substitution", a, " ".join(w["text"] for w in b), min(1.0, 0.7 * distance + doubt), causes, start, end, a[0]["at"])

    for tag, i1, i2, j1, j2 in SequenceMatcher(None, [w["norm"] for w in exp], [w["norm"] for w in got], autojunk=False).get_opcodes():
        a, b = exp[i1:i2], got[j1:j2]
        if tag == "replace":
            p = [w["p"] for w in b if w["p"] is not None]
            doubt = max(0.0, 0.6 - min(p, default=0.6)) * 0.8
            for x, y in zip(([w] for w in a), ([w] for w in b)) if len(a) == len(b) else ((a, b),):
                substituted(x, y, doubt)
        elif tag == "delete" and (content := [w for w in a if w["norm"] not in STOPWORDS]):
            near = got[j1]["start"] if j1 < len(got) else None
            add("omission", a, "∅", 0.7 if len(content) > 1 else 0.5, _causes(content[0], size), near, near, content[0]["at"])
    seen = {round(d["audio_start"], 1) for d in out if d["audio_start"] is not None}
    for s in segments or []:
        lp, cr, start = s.get("avg_logprob"), s.get("compression_ratio"), s.get("start")
        quiet = lp is not None and lp < -1.0
        if (quiet or cr is not None and cr > 2.4) and not (start is not None and round(start, 1) in seen):
            severity = 0.5 + (min(0.4, -1.0 - lp) if quiet else 0.2)
            out.append({"kind": "low_confidence", "expected": "(segment)", "heard": s.get("text") or "", "severity": severity, "causes": ["muddy_audio"], "audio_start": start, "audio_end": s.get("end"), "context": s.get("text") or ""})
    return sorted(out, key=lambda d: -d["severity"])


_DEFECT = struct(kind=STRING, expected=STRING, heard=STRING, severity=DOUBLE, causes=array(STRING), audio_start=DOUBLE, audio_end=DOUBLE, context=STRING)


def reading_defects(df: DataFrame, key: list[str], expected: str, heard: str) -> DataFrame:
    """One row for each defect of each row of ``df``: ``key`` columns, rank (from 1) and the defect's fields.

    ``heard`` is a text. Rows with a null text on either side give nothing. A narrow dependency; texts of equal comparable
    form are dropped in the JVM before any is aligned.
    """

    @F.pandas_udf(array(_DEFECT))
    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([defects(x, [{"word": t} for t, _, _ in tokens(y)]) for x, y in zip(a, b)])

    pairs = df.where(F.col(expected).isNotNull() & F.col(heard).isNotNull() & (F.lower(expected) != F.lower(heard)))
    return pairs.select(*key, F.posexplode(found(F.col(expected), F.col(heard))).alias("_pos", "_d")).select(*key, (F.col("_pos") + 1).alias("rank"), "_d.*")


def content_words(text: str) -> set[str]:
    words = {n for _, n, _ in tokens(text)}
    return words - STOPWORDS or words


def confirmed(base: DataFrame, strong: DataFrame, keys: list[str], slack: float = 0.5, bucket: float = 5.0) -> DataFrame:
    """The rows of ``strong`` that ``base`` agrees on: within a key, one with a shared content word of ``expected``, or for kind
    low_confidence one whose audio interval comes within ``slack`` seconds.

    Both tests are equi-joins: on words, and on buckets of time that an interval touches. Rows of null keys or intervals agree with none.
    What a test found is joined back by the values it was made from, so the order in which rows arrive makes no difference.
    """
    stop = F.array(*(F.lit(w) for w in sorted(STOPWORDS)))

    def words(c: str) -> Column:
        all_ = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(c), r"(.)\1{2,}", "$1"), F.lit("([a-z0-9]+(?:'[a-z]+)?)"), F.lit(1)))
        content = F.array_except(all_, stop)
        return F.when(F.size(content) > 0, content).otherwise(all_)

    def buckets(start: Column, end: Column) -> Column:
        return F.sequence(F.floor(start / bucket), F.floor(F.greatest(start, F.coalesce(end, start)) / bucket))

    spoken = strong.where("kind <> 'low_confidence'")
    by_word = spoken.select(*keys, "expected").distinct().withColumn("_w", F.explode(words("expected")))
    said = base.select(*keys, F.explode(words("expected")).alias("_w")).distinct()
    hits = by_word.join(said, [*keys, "_w"], "left_semi").select(*keys, "expected").distinct()
    spans = base.where("audio_start is not null").select(*keys, (F.col("audio_start") - slack).alias("_a"), (F.coalesce("audio_end", "audio_start") + slack).alias("_b"))
    spans = spans.withColumn("_k", F.explode(buckets(F.col("_a"), F.col("_b"))))
    low = strong.where("kind = 'low_confidence' and audio_start is not null").withColumn("_e", F.coalesce("audio_end", "audio_start"))
    at = [*keys, "audio_start", "_e"]
    each = low.select(*at).distinct().withColumn("_k", F.explode(buckets(F.col("audio_start"), F.col("_e"))))
    near = each.join(spans, [*keys, "_k"]).where("audio_start <= _b and _a <= _e").select(*at).distinct()
    found = spoken.join(hits, [*keys, "expected"], "left_semi").select(*strong.columns)
    return found.union(low.join(near, at, "left_semi").select(*strong.columns))


@F.pandas_udf(struct(reference=INT, matched=INT, missing_tail=BOOLEAN))
def word_recall(expected: pd.Series, heard: pd.Series) -> pd.DataFrame:
    """How many words of the expected text were heard, in order, and whether its last three were not."""
    rows = []
    for x, y in zip(expected, heard):
        a, b = [n for _, n, _ in tokens(x or "")], [n for _, n, _ in tokens(y or "")]
        hit = [False] * len(a)
        for block in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
            hit[block.a : block.a + block.size] = [True] * block.size
        rows.append((len(a), sum(hit), len(a) >= 3 and not any(hit[-3:])))
    return pd.DataFrame(rows, columns=["reference", "matched", "missing_tail"])
