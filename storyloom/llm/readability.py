"""Reading level of texts (problem 8).

A familiar-word formula: the share of words outside a high-frequency list, which comes from document frequencies over the
whole corpus, and the average sentence length; both are weighed by raters' grades.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sampling import bounded_sample
from ..sources.scratch import written
#: Labelled texts that weights are fitted on, about so many at most, chosen by hash.
MOST_LABELS = 20_000
#: Shares of a language's documents tried as the least share that makes a word familiar: 5 % to 40 % in equal steps. The
#: lowest bounds the list: no more than the average number of distinct words of a document, divided by it, can be that frequent.
FAMILIAR_SHARES = tuple(k / 40 for k in range(2, 17))
#: Grade from which a text counts as demanding.
DEMANDING = 10

# Frequent function words, by which a text's language is told.
_FUNCTION_WORDS = {
    "en": "the and of to a in that was it is he his had with for on not at her she they but said by from which were this all its be have are as an or",
    "de": "der die das und nicht war ist ein eine zu den dem des mit von sich er sie es auf für dass im hat hatte wie aber als was wer wo am",
    "fr": "le la les et des un une est était dans que qui ne pas pour sur avec il elle son sa du au ce se par plus de à a où",
    "es": "el la los las y de que en un una no se con por su es era del al lo como más pero sin para le ni dónde",
}
_LANGUAGE_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in _FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANGUAGE_OF[_w] = (*_LANGUAGE_OF.get(_w, ()), _lang)

_UNSEEN = re.compile("[\xad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"\w+(?:[-'’]\w+)*")
#: Scripts by their letters; those of the first three have no spaces between words, so single signs or pairs stand for words.
_SCRIPTS = {"Kana": "\u3040-\u30ff", "Han": "\u3400-\u9fff\uf900-\ufaff", "Thai": "\u0e00-\u0e7f", "Hangul": "\uac00-\ud7af", "Cyrillic": "\u0400-\u052f", "Arabic": "\u0600-\u06ff", "Devanagari": "\u0900-\u097f", "Greek": "\u0370-\u03ff"}
_OF_SCRIPT = {name: re.compile(f"[{c}]") for name, c in _SCRIPTS.items()}
_SIGNS = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[\u0e00-\u0e7f]{1,2}|[^\\W\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
_CAPITALIZED = re.compile(r"\b[A-ZÀ-ÖØ-ÞŒ]\w*(?:[-'’]\w+)*")
_OTHER_SCRIPT = re.compile("[Ͱ-ᷟⰀ-鿿가-힣]+")
#: Behind a sentence's end, and short titles whose full stop isn't one; a capitalized word at a beginning.
_NEXT = re.compile(r"[.!?…।؟۔]+[\"'”’»)\]」』]*\s+|\n\s*|[。！？]+[”」』]*\s*")
_TITLES = ("Mr. ", "Mrs. ", "Dr. ", "St. ", "Sr. ", "Sra. ")
_START = re.compile(r"(?:\A|\n|[.!?…][\"'”’»)\]]*\s)[\s\"'“‘«„¿¡(—–-]*([A-ZÀ-ÖØ-ÞŒ]\w*(?:[-'’]\w+)*)")


def language_of(words: Counter) -> str | None:
    """The language of most function words among lower-case ``words``; None if there are too few of them."""
    votes: Counter = Counter()
    for w, langs in _LANGUAGE_OF.items():
        if n := words.get(w):
            for lang in langs:
                votes[lang] += n / len(langs)
    total = words.total()
    if not votes:
        return None
    lang, n = max(votes.items(), key=lambda x: (x[1], x[0]))
    return lang if n >= max(1 if total < 15 else 2, 0.02 * total) else None


def script_of(text: str) -> str:
    """The script, other than Latin, of most letters; kana before Han where both occur; 'other' for none."""
    signs = Counter(text)
    apart = "".join(signs)
    counts = {name: sum(signs[c] for c in p.findall(apart)) for name, p in _OF_SCRIPT.items()}
    if counts["Kana"] > 0.1 * counts["Han"]:
        counts["Kana"] += counts["Han"]
    name = max(counts, key=counts.get)
    return name if counts[name] else "other"


def text_statistics(text: str | None) -> tuple[str | None, int, int, list[str], list[int]]:
    """(language, words, sentences, distinct words, how often each occurs but as a name).

    The language is en, de, fr or es, else the script's name, else 'other'; None for a text without words. A word with a capital
    inside a sentence is a name and so familiar, but for German, which capitalizes nouns too.
    """
    if not text:
        return None, 0, 0, [], []
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    words = Counter(_WORD.findall(text.lower()))
    for w in [w for w in words if w[0] <= "9" or w[0] == "_" or w[0].isdigit()]:
        del words[w]
    letters = sum(map(mul, map(len, words), words.values()))
    if not letters:
        return None, 0, 0, [], []
    if not text.isascii() and sum(map(len, _OTHER_SCRIPT.findall(text))) > 0.5 * letters:
        lang = script_of(text)
        if lang in ("Kana", "Han", "Thai"):
            words = Counter(w for w in _SIGNS.findall(text.lower()) if not w[0].isdigit() and w[0] != "_")
    else:
        lang = language_of(words) or "other"
    counts = list(words.values())
    if lang in ("en", "fr", "es"):
        names = Counter(map(str.lower, _CAPITALIZED.findall(text)))
        names.subtract(map(str.lower, _START.findall(text)))
        as_name = names.get
        counts = [max(0, n - as_name(w, 0)) for w, n in words.items()]
    sentences = len(_NEXT.findall(text.strip())) + 1 - sum(map(text.count, _TITLES))
    return lang, words.total(), max(1, sentences), list(words), counts


def _statistics(texts: DataFrame, key: str, text: str) -> DataFrame:
    schema = "_key long, lang string, n_words int, n_sentences int, words array<string>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(t) for t in batch.column(1).to_pylist()]
            at = pa.array(np.cumsum([0, *(len(r[3]) for r in rows)]), pa.int32())
            columns = [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.ListArray.from_arrays(at, pa.array(list(chain.from_iterable(r[3] for r in rows)), pa.string())),
                pa.ListArray.from_arrays(at, pa.array(list(chain.from_iterable(r[4] for r in rows)), pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "lang", "n_words", "n_sentences", "words", "counts"])

    return texts.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def _tier_counts(statistics: DataFrame, tiers: dict[str, dict[str, int]]) -> DataFrame:
    """(_key, lang, n_words, n_sentences, outside): outside[i] words aren't familiar at the i-th of FAMILIAR_SHARES."""
    n = len(FAMILIAR_SHARES)
    known = {lang: (pa.array(list(t), pa.string()), np.array([*t.values(), 0])) for lang, t in tiers.items()}
    nothing = (pa.array([], pa.string()), np.zeros(1, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            outside = np.zeros((len(langs), n), np.int32)
            for lang in dict.fromkeys(langs):
                at = np.flatnonzero(langs == lang)
                words, counts = (batch.column(c).take(pa.array(at)) for c in ("words", "counts"))
                listed, tier = known.get(lang, nothing)
                found = np.asarray(pc.fill_null(pc.index_in(words.flatten(), value_set=listed), -1))
                row = np.repeat(np.arange(len(at)), np.asarray(pc.list_value_length(words)))
                by_tier = np.bincount(row * (n + 1) + tier[found], weights=np.asarray(counts.flatten()), minlength=len(at) * (n + 1))
                outside[at] = by_tier.reshape(-1, n + 1)[:, :n].cumsum(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(langs) * n + 1, n, dtype=np.int32)), pa.array(outside.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_key", "lang", "n_words", "n_sentences")), lists], names=["_key", "lang", "n_words", "n_sentences", "outside"])

    return statistics.mapInArrow(run, "_key long, lang string, n_words int, n_sentences int, outside array<int>")


def _logistic(x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (on standardized columns with a leading 1, returned for raw columns) and the loss on what is kept."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread][keep]
    y = y[keep]
    b = np.zeros(z.shape[1])
    ridge = np.diag([1e-3] + [0.05] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ b)
        b += np.clip(step, -3, 3)
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ b, -30, 30))), 1e-6, 1 - 1e-6)
    loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    raw = b[1:] / spread
    return np.r_[b[0] - raw @ mean, raw], loss


def _linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of grade on the raw columns; far-off grades count less (Huber)."""
    z, w = np.c_[np.ones(len(x)), x], np.ones(len(x))
    b = np.zeros(z.shape[1])
    for _ in range(20):
        b = np.linalg.solve((z * w[:, None]).T @ z + 1e-6 * np.eye(z.shape[1]), (z * w[:, None]).T @ y)
        w = 1 / np.maximum(1, np.abs(z @ b - y) / 1.5)
    return b


def fit_formula(rows: list[tuple[str, int, int, list[int], float]]) -> dict:
    """Familiar share and weights per language from (language, words, sentences, outside, grade).

    One familiar share serves all languages: the one of least total loss in telling demanding texts from others. Labels
    that the first fit contradicts outright are left out of the second. A language with fewer than 8 labels of either
    side is fitted together with all, and so are all languages without a weight of their own (named '').
    """
    x0 = np.array([(r[1], max(1, r[2])) for r in rows], float).reshape(-1, 2)
    grade = np.array([r[4] for r in rows], float)
    demanding = (grade >= DEMANDING - 0.5).astype(float)
    lang = np.array([r[0] for r in rows])
    outside = np.array([r[3] for r in rows], float).reshape(len(rows), len(FAMILIAR_SHARES))
    groups = {name: lang == name for name in (*_FUNCTION_WORDS, "")}
    for name, at in groups.items():
        if demanding[at].sum() < 8 or (1 - demanding[at]).sum() < 8:
            groups[name] = np.ones(len(rows), bool)
    best: dict = {}
    if not len(rows) or demanding.sum() in (0, len(rows)):
        return {"share": FAMILIAR_SHARES.index(0.175), "weights": {n: [-14.0, 22.0, 0.16] for n in groups}, "grades": {n: [1.0, 12.0, 0.12] for n in groups}}
    for i in range(len(FAMILIAR_SHARES)):
        x = np.c_[outside[:, i] / x0[:, 0], x0[:, 0] / x0[:, 1]]
        total, weights = 0.0, {}
        for name, at in groups.items():
            own, keep = x[at], np.ones(int(at.sum()), bool)
            for _ in range(2):
                b, loss = _logistic(own, demanding[at], keep)
                p = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(own)), own] @ b, -30, 30)))
                dropped = int((~keep).sum())
                keep = np.abs(p - demanding[at]) < 0.97
            total += loss + 3.5 * dropped
            weights[name] = b.tolist()
        if not best or total < best["loss"]:
            best = {"loss": total, "share": i, "weights": weights, "grades": {name: _linear(x[at], grade[at]).tolist() for name, at in groups.items()}}
    return best


def familiar_tiers(stats: DataFrame) -> dict[str, dict[str, int]]:
    """Language → word → how many of FAMILIAR_SHARES its share of the language's documents reaches; words that reach none are left out.

    Words are counted over all documents; only those of the list reach the driver.
    """
    told = stats.where("lang is not null")
    of = {r["lang"]: r["n"] for r in told.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not of:
        return {}
    least = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v * FAMILIAR_SHARES[0])) for k, v in of.items()))
    frequent = told.select("lang", F.explode("words").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    tiers: dict[str, dict[str, int]] = {}
    for r in frequent.collect():
        tiers.setdefault(r["lang"], {})[r["w"]] = sum(r["n"] >= s * of[r["lang"]] for s in FAMILIAR_SHARES)
    return tiers


def graded(counted: DataFrame, labels: DataFrame, key: str, grade: str) -> list[tuple]:
    """(key, language, words, sentences, outside, grade) of about MOST_LABELS labelled texts at most, chosen by hash; the grade is the
    median of the valid ones. Null and impossible grades, and texts without words, are left out."""
    valid = labels.select(F.col(key).cast("long").alias("_id"), F.col(grade).cast("double").alias("_g"), *([F.col("rater")] if "rater" in labels.columns else [])).where("_id is not null and _g between 1 and 13").distinct()
    wanted = bounded_sample(valid, "_id", MOST_LABELS).groupBy("_id").agg(F.median("_g").alias("_g"))
    rows = counted.where("lang is not null").join(wanted, F.col("_key") == F.col("_id")).collect()
    return sorted((r["_key"], r["lang"], r["n_words"], r["n_sentences"], r["outside"], r["_g"]) for r in rows)


def reading_levels(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade") -> DataFrame:
    """(``key``, lang, unfamiliar, words_per_sentence, level, demanding) for each text, in any language.

    ``unfamiliar`` is the share of words outside the high-frequency list of the text's language, ``level`` the grade by the formula,
    1 to 13, and ``demanding`` whether the text is one for grade 10 or above as raters use the grades. The language is
    told by the text: en, de, fr, es, or else a script's name or 'other'; languages without enough labels have the formula
    fitted on all. Null texts and those without words have a null language and level and aren't demanding; repeated rows give one
    each. ``labels`` (``key``, ``grade``) may have repeated rows, several raters (the median counts), null or impossible
    grades (left out); without usable labels built-in weights serve. Other columns are left out. Empty tables give an empty result.

    Every text is parsed once; the words found are written to the shared folder, counted, and compared with the list from there.
    """
    stats = written(_statistics(texts, key, text))
    counted = written(_tier_counts(stats, familiar_tiers(stats)))
    model = fit_formula([r[1:] for r in graded(counted, labels, key, grade)])
    unfamiliar = F.get("outside", F.lit(model["share"])) / F.nullif(F.col("n_words"), F.lit(0))
    length = F.col("n_words") / F.nullif(F.col("n_sentences"), F.lit(0))

    def formula(weights: dict[str, list[float]]):  # noqa: ANN202
        of = lambda b: F.lit(b[0]) + b[1] * F.col("unfamiliar") + b[2] * F.col("words_per_sentence")
        return F.coalesce(*(F.when(F.col("lang") == k, of(b)) for k, b in weights.items() if k), of(weights[""]))

    scored = counted.select(F.col("_key").alias(key), "lang", unfamiliar.alias("unfamiliar"), length.alias("words_per_sentence"))
    level = F.round(F.greatest(F.lit(1.0), F.least(F.lit(13.0), formula(model["grades"]))), 2)
    return scored.withColumn("level", F.when(F.col("lang").isNotNull(), level)).withColumn("demanding", F.coalesce(formula(model["weights"]) > 0, F.lit(False)))
