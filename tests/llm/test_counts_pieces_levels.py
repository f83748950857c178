from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyloom.llm import ngrams as N
from storyloom.llm import readability as L
from storyloom.llm import splitting as P


def brute_counts(rows, longest):
    records = {}
    for g, r, terms in rows:
        if r is not None and terms:
            records.setdefault((g, r), set()).add(tuple(t for t in terms if t))
    cf, df = Counter(), Counter()
    for (g, _), seqs in records.items():
        grams = [(g, s[i : i + n]) for s in seqs for i in range(len(s)) for n in range(1, longest + 1) if i + n <= len(s)]
        cf.update(grams)
        df.update(set(grams))
    return {(g, " ".join(t)): (len(t), cf[g, t], df[g, t]) for g, t in cf}


@pytest.mark.parametrize("longest", [1, 3])
def test_counts_against_brute_force(spark, longest):
    r = random.Random(longest)
    rows = [(r.choice("gh"), r.choice([None, *range(60)]), [r.choice(["a", "a", "a", "b", "ä", "c d", "", "e"]) for _ in range(r.randrange(6))] or None) for _ in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "g string, r int, t array<string>").withColumn("occurrences", F.lit("clash"))
    got = {(x["g"], x["ngram"]): (x["n_terms"], x["occurrences"], x["records"]) for x in N.ngram_counts(df, "g", "r", "t", longest).collect()}
    assert got == brute_counts(rows, longest)
    assert N.ngram_counts(df.limit(0), "g", "r", "t", longest).count() == 0


def test_terms_and_verdicts(spark):
    df = spark.createDataFrame([("Don't STOP—über 2²", " Kind\xa0"), (None, None), ("", "  ")], "a string, b string")
    got = df.select(N.terms_of(F.col("a")), N.whole_value(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(["don", "t", "stop", "über", "2²"], ["kind"]), (None, None), ([], [])]
    counts = spark.createDataFrame([("x", 2), ("y", 3), ("z", 6), ("w", 5)], "t string, records long")
    marked = N.marked(counts, spark.range(100).withColumnRenamed("id", "r"), "r").collect()
    assert {r["t"]: r["verdict"] for r in marked} == {"x": "rare", "y": None, "z": "common", "w": None}


def longest_run(text):
    return max(map(len, re.split("[ \t\n　。！？、，；：…]", text)))


def test_pieces():
    r = random.Random(7)
    for _ in range(400):
        limit = r.randrange(5, 60)
        overlap = r.choice([0, 0, limit // 10, limit // 3])
        text = "".join(r.choice("abcdefgh é\xa0​—- \n.,。，।”") if r.random() < 0.9 else "x" * r.randrange(30) for _ in range(r.randrange(300)))
        own = P.bisect_text(text, limit, overlap)
        assert "".join(text[a:b] for a, b, _ in own) == text
        assert all(b - a <= limit for a, b, _ in own)
        assert any(f for *_, f in own) == (len(text) > limit and longest_run(text) > limit)
        wide = P.with_overlap(own, limit, overlap)
        assert all(b - a <= limit and own[i][0] - a <= overlap for i, (a, b, _) in enumerate(wide))
    assert P.bisect_text("One sentence here. Another sentence there.", 30, 0) == [(0, 19, False), (19, 42, False)]
    assert P.bisect_text("", 5, 0) == []


def test_long_texts_are_cut_in_time_in_proportion():
    start = time.perf_counter()
    pieces = P.bisect_text("The cat sat, then left. " * 80_000, 400, 40)
    assert time.perf_counter() - start < 10 and len(pieces) > 4000


def test_piece_rows(spark):
    chunks = spark.createDataFrame([(1, "p", "word " * 30, 100), (2, "p", "y" * 50, None), (3, "p", "short", 0), (4, "q", "z" * 99, 0), (5, None, "z" * 99, 0), (6, "p", None, 0), (1, "p", "word " * 30, 100)], "row_id long, profile string, text string, text_start int").withColumn("piece", F.lit("clash"))
    profiles = spark.createDataFrame([("p", 40, 8), ("r", None, 0)], "profile string, max_chars int, overlap_chars int")
    rows = P.split_oversized(chunks, profiles).collect()
    assert {r["row_id"] for r in rows} == {1, 2} and all(len(r["text"]) <= 40 and r["char_end"] - r["char_start"] == len(r["text"]) for r in rows)
    one = [r for r in rows if r["row_id"] == 1]
    assert {r["text_start"] - r["char_start"] for r in one} == {100} and len(one) % 2 == 0
    assert all(r["text_start"] is None for r in rows if r["row_id"] == 2)
    assert [r["row_id"] for r in P.cut_inside_runs(P.split_oversized(chunks, profiles)).collect()] == [2]
    assert P.split_oversized(chunks.limit(0), profiles).count() == P.split_oversized(chunks, profiles.limit(0)).count() == 0


EASY = ["The dog ran to the barn with {}.", "{} sat on the cart and had a bun.", "It was a big day, so {} put the cat in the box."]
HARD = ["Notwithstanding the metaphysical methodology of the commission, {} obfuscated a jurisdictional consolidation, inasmuch as the administrative reconciliation could hardly be distinguished from it.", "The irreconcilable accountability of {} counterbalanced indeterminate verification."]


def test_levels(spark):
    r = random.Random(9)
    docs, grades = [], []
    for i in range(300):
        hard = i % 6 == 0
        docs.append((i, " ".join(r.choice(HARD if hard else EASY).format(r.choice(["Wren", "Ash", "Bramblethwaite"])) for _ in range(12))))
        if i % 3 == 0:
            grades.append((i, "a", (12 if hard else 2) if i != 9 else 99))
    docs += [(1000, None), (1001, " "), (1002, "这是中文。" * 9), (1003, "Это русский текст."), (1, docs[1][1])]
    texts = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("clash"))
    labels = spark.createDataFrame([*grades, *grades[:5], (12, "b", None), (6, "b", 2)], "doc_id long, rater string, grade int")
    every = L.reading_levels(texts, labels).collect()
    assert len(every) == 305 and {x["doc_id"]: x["lang"] for x in every if x["doc_id"] > 999} == {1000: None, 1001: None, 1002: "Han", 1003: "Cyrillic"}
    assert all((x["level"] is None) == (x["lang"] is None) and (x["level"] is not None or not x["demanding"]) for x in every)
    rows = [x for x in every if x["lang"] == "en"]
    assert len(rows) == 301
    assert all(x["demanding"] == (x["doc_id"] % 6 == 0) for x in rows)
    assert all((x["level"] > 8) == x["demanding"] for x in rows)
    assert L.reading_levels(texts.limit(0), labels).count() == 0
    assert L.reading_levels(texts, labels.limit(0)).count() == 305


@pytest.mark.parametrize(("text", "lang"), [("Der Hund ist nicht da und das Tor war zu.", "de"), ("Il y a la clé ici, dit Ondine.", "fr"), ("Dax tiene el mapa y la llave de la torre.", "es"), ("The gate was shut.", "en"), ("cart sack stone fish", None)])
def test_language_is_told_by_the_text(text, lang):
    assert L.language_of(Counter(re.findall(r"\w+", text.lower()))) == lang


def test_names_are_familiar():
    lang, words, sentences, distinct, counts = L.text_statistics("The old gate of Bramblewick fell. Quickly it was shut by the Bramblewick guard.")
    by = dict(zip(distinct, counts))
    assert (lang, words, sentences) == ("en", 14, 2) and by["bramblewick"] == 0 and by["quickly"] == 1 and by["the"] == 2
