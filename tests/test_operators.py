from __future__ import annotations

import datetime as dt
import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from storyloom.operators import alignment as A
from storyloom.operators import blocks as B
from storyloom.operators import chunking as C
from storyloom.operators import normalize as M
from storyloom.operators import phones as P
from storyloom.operators import rollups as R
from storyloom.operators import windows as W
from storyloom.operators.figures import numbers
from storyloom.operators.notices import notices_of

# Conformance cases of the normalization steps.
CASES = [
    ("normalize_numbers", "£1.4m", "one point four million pounds"),
    ("normalize_numbers", "£900k", "nine hundred thousand pounds"),
    ("normalize_numbers", "£2 million", "two million pounds"),
    ("normalize_numbers", "£50,000", "fifty thousand pounds"),
    ("normalize_numbers", "£0.176m", "one hundred seventy-six thousand pounds"),
    ("normalize_numbers", "£4,163,432", "four million one hundred sixty-three thousand four hundred thirty-two pounds"),
    ("normalize_numbers", "$5.24m", "five million two hundred forty thousand dollars"),
    ("normalize_numbers", "€3k", "three thousand euros"),
    ("normalize_numbers", "2000000000", "two billion"),
    ("normalize_punctuation", "£9,800/week", "£9,800 per week"),
    ("normalize_numbers", "We were 147.8 but we played worse", "We were one hundred forty-seven point eight but we played worse"),
    ("normalize_numbers", "0.28m", "two hundred eighty thousand"),
    ("normalize_numbers", "1.39%", "one point three nine%"),
    ("normalize_numbers", "the 3rd of 4, a 15-year-old", "the third of 4, a fifteen-year-old"),
    ("normalize_numbers", "42 of 007 and 100", "42 of 007 and one hundred"),
    ("normalize_time_formats", "at 7 pm", "at seven P M"),
    ("normalize_time_formats", "at 10 a.m. sharp", "at ten A M sharp"),
    ("normalize_dates", "5 May, 1995 and May 23, 2028", "fifth of May, nineteen ninety-five and May twenty-third, twenty twenty-eight"),
    ("normalize_acronyms", "Mr. X vs. Y etc.\nDr. Z", "Mister X versus Y etcetera.\nDoctor Z"),
]


def test_normalization_steps(spark):
    df = spark.createDataFrame([*CASES, ("normalize_numbers", None, None), ("no_such_step", "x", None)], "step string, text string, expected string")
    for r in df.select(M.normalized(F.col("text"), F.col("step")).alias("got"), "expected").collect():
        assert r["got"] == r["expected"]


def test_whole_normalization_and_notices(spark):
    df = spark.createDataFrame([('[note]\n14.\n"Hi--you"...\n* * *\nThe FA',), (None,), ("a\n***\n---\nb",)], "t string")
    assert [r[0] for r in df.select(M.normalized(F.col("t"), respelling={"hi": "high"})).collect()] == ['"high—you"…\n\nThe F. A.', None, "a\n\nb"]
    gone = lambda t, *sites: notices_of(sites).without(t)
    assert gone("One. This tale was stolen from Some Site. Two.", "some site") == "One. Two."
    assert gone("Nobody stole it.\nReport any sightings.") == "Nobody stole it.\n"


@pytest.mark.parametrize(("text", "spoken"), [("10.200.300", "ten point two zero zero.three hundred"), ("£5.5kg", "five pounds.5kg"), ("12,345.6", "12,three hundred forty-five point six"), ("a total of 1999", "a total of one thousand nine hundred ninety-nine"), ("1999 kg", "one thousand nine hundred ninety-nine kg"), ("24-hour 2-1", "twenty-four-hour 2-1"), ("B52 300kg", "B52 300kg")])
def test_figures(text, spoken):
    assert numbers(text) == spoken


# Sentences that are notices, each by another rule, and sentences that only look like one.
NOTICES = [
    "This tale has been unlawfully lifted from Royal Road.", "The genuine version is on RoyalRoad!", "Stolen content warning: this belongs on Royal Road.", "Unauthorized duplication is theft.", "If you see it on Amazon, please report it.",
    "This book on Amazon was pirated.", "Support the authors who deserve it!", "You could be reading stolen content.", "Reading on this site?", "Read the chapter on the original site.", "Please report any sightings.", "Report any occurrences.",
]
NO_NOTICES = ["They rode along the royal road.", "The Amazon is a river.", "She sold a book on Amazon.", "Authors wrote the report.", "He could be reading."]


def test_notices_of_the_default_site(spark):
    rows = [(s, True) for s in NOTICES] + [(s, False) for s in NO_NOTICES]
    df = spark.createDataFrame([(f"One. {s} Two.", s, gone, "remove_notices") for s, gone in rows], "text string, s string, gone boolean, step string")
    for r in df.select("s", "gone", M.normalized(F.col("text")).alias("a"), M.normalized(F.col("text"), F.col("step")).alias("b"), M.normalized(F.col("text"), F.col("step"), sites=("some site",)).alias("c")).collect():
        wanted = "One. Two." if r["gone"] else f"One. {r['s']} Two."
        assert (r["a"], r["b"]) == (wanted, wanted)
        assert (r["c"] != wanted) == (r["s"] in (NOTICES[1], NOTICES[2]))


def test_chunks():
    text = "First sentence here. Second one follows, with a comma. Third.\n\nNext paragraph."
    found = C.chunks_of(text, C.Profile(40))
    assert max(map(len, found)) <= 40 and " ".join(found).split() == text.split()
    assert C.chunks_of("  \n ", C.SHORT) == []
    assert C.chunks_of("A. B.\n\nC.", C.Profile(40, merge_floor=10)) == ["A. B. C."]
    assert C.chunks_of('He said "go."', C.SHORT) == ["He said \"go."]
    with pytest.raises(ValueError, match="white space"):
        C.chunks_of("x" * 300, C.SHORT)
    for seed in range(30):
        r = random.Random(seed)
        words = " ".join(r.choice(["a", "into the", "word.", "more,", "U. S.", '"q"', "longish"]) for _ in range(200))
        for profile in (C.SHORT, C.LONG):
            found = C.chunks_of(words, profile)
            assert max(map(len, found)) <= profile.max_chars
            if not profile.strip_trailing_quotes:
                assert " ".join(found).split() == words.split()


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "y" * 600), (1, "One. Two.")], "id long, text string").withColumn("chunk", F.lit("clash"))
    got = sorted((r["id"], r["chunk"], r["text"], r["error"] is not None) for r in C.chunk_texts(df, "id", "text", C.LONG).collect() if r["chunk"] or r["error"])
    assert got == [(1, 1, "One. Two.", False)] * 2 + [(3, None, None, True)]
    assert C.chunk_texts(df.limit(0), "id", "text").count() == 0


def test_ratio_and_comparison(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("a", ""), ("x" * 400, "x" * 399 + "y"), (None, "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(A.seq_ratio("a", "b")).collect()]
    assert got == [None if None in p else SequenceMatcher(None, *p, autojunk=False).ratio() for p in pairs]
    c = spark.createDataFrame([("The cat sat.", "the bat sat")], "a string, b string").select(A.compared(F.col("a"), F.col("b")).alias("c")).first()["c"]
    assert (c["missing"], c["extra"], c["passed"]) == (["cat"], ["bat"], True)


def test_defects():
    heard = lambda s, p=0.9: [{"word": w, "start": float(i), "end": i + 0.5, "probability": p} for i, w in enumerate(s.split())]
    assert A.defects("He had 250 men", heard("he had two hundred fifty men")) == []
    assert A.defects("Vitamin C works", heard("vitamin see works")) == []
    d = A.defects("Then Brannoc left the hall", heard("then banner left the hall"))
    assert [(x["kind"], x["expected"], x["heard"], x["causes"]) for x in d] == [("substitution", "Brannoc", "banner", ["unusual_word"])]
    assert [x["severity"] for x in A.defects("go to the old red barn now", heard("go to the now"))] == [0.7]
    assert A.defects("it is the end", heard("it is end")) == []  # only a stopword is lost
    low = A.defects("fine", heard("fine"), [{"start": 3.0, "end": 4.0, "avg_logprob": -1.3, "text": "mud"}])
    assert low[0]["kind"] == "low_confidence" and low[0]["severity"] == pytest.approx(0.8)


def test_confirmation_by_words_and_times(spark):
    kind = "id int, chunk int, kind string, expected string, audio_start double, audio_end double"
    base = spark.createDataFrame([(1, 1, "substitution", "the Cat", 1.0, 2.0), (2, 2, "omission", "dog", None, None)], kind)
    strong = spark.createDataFrame([(1, 1, "omission", "cat", None, None), (2, 1, "omission", "the", None, None), (3, 1, "low_confidence", "(segment)", 2.4, 9.0), (4, 1, "low_confidence", "(segment)", 2.6, 9.0), (5, 2, "omission", "cat", None, None), (6, None, "omission", "cat", None, None)], kind)
    assert sorted(r["id"] for r in A.confirmed(base, strong, ["chunk"]).collect()) == [1, 3]
    assert A.confirmed(base.limit(0), strong, ["chunk"]).count() == 0


def test_confirmation_whatever_the_order_of_rows(spark):
    """As behind a shuffle on several executors, rows come in another order whenever the frame is evaluated."""
    kind = "id int, chunk int, kind string, expected string, audio_start double, audio_end double"
    base = spark.createDataFrame([(0, c, "omission", f"word{c}", float(c), None) for c in range(0, 400, 2)], kind)
    rows = [(c, c, "omission", f"word{c}", None, None) for c in range(400)] + [(1000 + c, c, "low_confidence", "(segment)", float(c), c + 0.2) for c in range(400)]

    def mixed(frames):
        for f in frames:
            yield f.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "big"))

    strong = spark.createDataFrame(rows + rows[:3], kind).coalesce(1).mapInPandas(mixed, kind)
    wanted = sorted(r[0] for r in rows + rows[:3] if r[1] % 2 == 0)
    assert sorted(r["id"] for r in A.confirmed(base, strong, ["chunk"]).collect()) == wanted


def test_phones(spark):
    assert P.injected("abcdef", "abcxyzuvdef") == [{"phones": "xyzuv", "length": 5, "position": 0.27, "severity": 0.5}]
    assert P.tail_artifact("Here.", "abc", "abckl") == {"phones": "kl", "length": 2, "displaced": "", "severity": 0.6}
    assert P.tail_artifact("Room 2.", "abc", "abckl") is None and P.tail_artifact("Here.", "abc", "abd") is None
    assert P.best_window("abc", "xxabcxx") < 0.4 and P.best_window("", "x") == 0 and P.best_window("a", "") == 1
    df = spark.createDataFrame([("ˈsɜːtn̩", "sɜtən"), (None, "a"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(P.phone_distance(F.col("a"), F.col("b"))).collect()] == [0.0, None, 0.0]


def test_tables_rosters_and_specifications(spark):
    assert B.tables_to_prose("x\n| A | B |\n|---|---|\n| 1 | 2 |\n| 3 |\ny") == "x\nA: 1, B: 2.\ny"
    assert B.tables_to_prose("| Team | Pts | P | W | D | L |\n| X | 10 | 4 | 3 | 0 | 1 |") == "1st: X, 10 points, 4 games, 3 wins, 1 losses."
    assert B.tables_to_prose("| only |") == "| only |"
    head, loan = "No. Name Pos Age Int Wage [CA PA] CA +/-", "Name Pos Age Wage [CA PA] CA +/- Loan Club Loan Tier"
    assert B.rosters_to_prose(f"{head}\n1. Marek Masarik GK 38 SVK 30000 [152 165] 11\n\nProse.").startswith("Number 1, Marek Masarik, goalkeeper, age 38, Slovakia, wage £30000. PA 165, CA 152, up 11.")
    assert B.roster_row("12. Magnus Evergreen D,DM,M 31 SCO 18000 [150 -2] 16") == "Number 12, Magnus Evergreen, defender, defensive midfielder, midfielder, age 31, Scotland, wage £18000. PA minus 2, CA 150, up 16."
    assert B.rosters_to_prose(f"{loan}\nNasa DR 23 4000 [126 150] 12 College CL") == "Nasa, defender right, age 23, wage £4000. PA 150, CA 126, up 12. On loan at College, loan tier CL."
    assert B.rosters_to_prose(head) == head
    assert B.rosters_to_prose("P4 - W3 - D0 - L1 - Goals For 9 - Goals Against 2 - Goal Difference 7 - Points 9").endswith("goal difference 7, 9 points.")
    df = spark.createDataFrame([(1, "Prose here.\n\nPace xx Flair xx\n\nSet Pieces xx.x\nGk DLRC\n\n***\nAfter."), (2, None), (3, "A xx\nB xx")], "id int, text string")
    got = B.spec_blocks(df, "id", "text").collect()
    assert [(r["id"], r["lines"]) for r in got] == [(1, ["Pace xx Flair xx", "Set Pieces xx.x", "Gk DLRC"])]
    fields = spark.createDataFrame([("Pace xx Set Pieces 12 Nationality",)], "t string").select(B.spec_fields(F.col("t"))).first()[0]
    assert [tuple(f) for f in fields] == [("Pace", "xx"), ("Set Pieces", "12"), ("Nationality", None)]


def test_removals(spark):
    df = spark.createDataFrame([("A note. Story. A note.", [("trailing", "A note."), ("chunk", "gone")]), (None, [("chunk", "x")])], "t string, r array<struct<kind:string,text:string>>")
    got = [r[0] for r in df.select(B.apply_removals(F.col("t"), F.col("r"))).collect()]
    assert (got[0]["text"], got[0]["missing"]) == ("A note. Story.\n", ["gone"]) and got[1]["text"] is None


def test_ordered_operators(spark):
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (5, 5, 3, 20)]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(at)], "k string, i int, t timestamp_ntz")
    got = [r[0].second for r in df.orderBy("i").select(W.increasing_times(F.col("t"), ["k"], ["i"]).cast("timestamp_ntz")).collect()]
    assert got == [5, 6, 7, 20]
    n = spark.createDataFrame([("a", i, b) for i, b in enumerate([1, 1, 2, 3, 1, 2])], "k string, i int, b int")
    assert [r["segment"] for r in W.segments(n, ["k"], ["i"], "b").orderBy("i").collect()] == [1, 1, 1, 1, 2, 2]
    assert [r["segment"] for r in W.segments(n, ["k"], ["i"], "b", "literal").orderBy("i").collect()] == [1, 2, 2, 2, 3, 3]
    assert [r["n"] for r in W.numbered(n.repartition(3), ["i"]).orderBy("i").collect()] == [1, 2, 3, 4, 5, 6]
    assert W.numbered(n.limit(0), ["i"]).count() == 0
    g = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 0.5, 1.0, 1.0])], "k string, i int, g double")
    assert [round(r["smoothed"], 4) for r in W.limiter_gain(g, ["k"], "i", "g", 1).orderBy("i").collect()] == [round(x / 3, 4) for x in (2.0, 1.5, 2.0, 2.5)]


def test_numbers_over_several_sampled_ranges(spark):
    """More rows than the sample of the ranges' bounds holds, and ranges that aren't merged into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000, numPartitions=4).select(((F.col("id") * 7919) % 40_009).alias("at"))
        got = [r["n"] for r in W.numbered(df, ["at"], "n", 11).orderBy("at").collect()]
        assert got == list(range(11, 40_011))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rollups(spark):
    chunks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "chapter string, chunk int")
    findings = spark.createDataFrame([("a", 1), ("a", 1), ("c", 9)], "chapter string, chunk int")
    got = {(r["chapter"], r["is_total"]): (r["chunks"], r["findings"], r["bad_chunks"], r["rate"]) for r in R.issue_rates(findings, chunks, ["chapter"]).collect()}
    assert got == {("a", False): (2, 2, 1, 50.0), ("b", False): (1, 0, 0, 0.0), (None, True): (3, 2, 1, 33.33)}
    takes = spark.createDataFrame([(1, 1, False, 0.1, 0.9), (1, 2, True, None, 0.5), (1, 3, True, None, 0.1), (2, 1, False, 0.2, 0.3), (2, 2, False, 0.2, 0.3)], "t int, attempt int, clean boolean, shortfall double, severity double")
    assert sorted((r["t"], r["attempt"]) for r in R.best_take(takes, ["t"]).collect()) == [(1, 2), (2, 1)]
    o = spark.createDataFrame([("s", 5), ("s", 10), ("s", 3)], "k string, at int")
    w = spark.createDataFrame([("s", 3, "x"), ("s", 7, "y")], "k string, start int, owner string")
    assert sorted((r["at"], r["owner"]) for r in R.owner_as_of(o, w, ["k"], "at", "start", "owner").collect() if r["at"] != 3) == [(5, "x"), (10, "y")]
    assert [r["owner"] for r in R.owner_as_of(o, w, ["k"], "at", "start", "owner").where("at = 3").collect()] == [None]
    m = R.merged_outer(o.groupBy("k").count(), spark.createDataFrame([("s", 1), ("z", 2)], "k string, count long"), ["k"])
    assert sorted((r["k"], r["count"], r["side"]) for r in m.collect()) == [("s", 3, "both"), ("z", 2, "right")]


# Cases of choosing between what was shipped and a new take (broken words, strays, distances, kept).
TAKES = [
    (0, 0, 0, 0.5, 0.5, False), (0, 0, 0, 0.5, 0.445, False), (0, 0, 0, 0.5, 0.435, True), (0, 3, 3, 0.4, 0.345, False), (1, 4, 0, 0.5, 0.5, False), (1, 0, 0, 0.9, 0.1, False),
    (0, 4, 2, 0.2, 0.6, True), (0, 2, 4, 0.6, 0.1, False), (0, 0, 0, 0.3, 0.4, False), (0, 3, 3, 0.8, 0.2, True), (0, 0, 0, 0.0, 0.0, False), (0, 2, 0, 0.0, 0.0, True),
]


def test_keep_take(spark):
    df = spark.createDataFrame(TAKES, "b int, s int, t int, d double, e double, kept boolean")
    for r in df.select(R.keep_take(*(F.col(c) for c in "bstde")).alias("got"), "kept").collect():
        assert r["got"] == r["kept"]
