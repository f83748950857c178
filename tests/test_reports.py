from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from storyloom.operators import commentary as C
from storyloom.operators import phones as P
from storyloom.operators import reports as R
from storyloom.operators import takes as K
from storyloom.operators import verdicts as V


def test_positions_follow_the_alignment():
    r = random.Random(5)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        wanted = {}
        for _, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            wanted.update({i: j1 + (i - i1) * (j2 - j1) // (i2 - i1) for i in range(i1, i2)})
        assert V.positions(a, b) == [wanted[i] for i in range(len(a))]


def test_verdicts(spark):
    assert V.word_verdict("and", "ænd", "ən")["source"] == "whisper" and V.word_verdict("and", "ænd", "ən")["distance"] == 0.0
    assert V.word_verdict("garble", "gɑɹbəl", "ʃiʃiʃi")["source"] == "xtts" and V.word_verdict("garble", "gɑɹbəl", "g")["source"] == "inconclusive"
    assert [v["actual_phones"] for v in V.word_verdicts(["cat", "sat"], ["kæt", "sæt"], "kætsæt", "kætsɪt")] == ["kæt", "sɪt"]
    df = spark.createDataFrame([(["cat"], ["kæt"], "kæt", "kæt"), (None, None, None, None), (["x"], [""], "a", "a")], "w array<string>, p array<string>, e string, h string")
    got = [r[0] for r in df.select(V.verdicts(F.col("w"), F.col("p"), F.col("e"), F.col("h"))).collect()]
    assert len(got[0]) == 1 and got[1:] == [[], []]


@pytest.mark.parametrize(("word", "some"), [("Wrexham", ["Rexham", "Wreksham", "Reksham", "Reksum"]), ("knoll", ["noll", "knol", "nol"]), ("a", [])])
def test_respellings(word, some):
    found = V.respellings(word)
    assert set(some) <= set(found) and word not in found and len(found) == len({x.lower() for x in found}) <= 12


def test_best_window_against_brute_force():
    r = random.Random(6)
    for _ in range(500):
        a, b = "".join(r.choice("abc") for _ in range(r.randrange(7))), "".join(r.choice("abcd") for _ in range(r.randrange(20)))
        if a and b:
            n = len(a)
            every = [b[i : i + k] for k in {max(1, n - 2), n, n + 2, n + 4} for i in range(max(1, len(b) - k + 1))]
            assert P.best_window(a, b) == pytest.approx(min(1 - SequenceMatcher(None, a, x, autojunk=False).ratio() for x in every))


def test_commentary(spark):
    rows = [(1, i, t) for i, t in enumerate(["Story.", None, "Next: more", "Story. Thanks for your supporrt!", "Bonus story", "Check out this"])] + [(None, 0, "Story"), (2, 0, "Please note this"), (2, 1, "")]
    df = spark.createDataFrame(rows, "ch int, chunk int, text string").withColumn("_last", F.lit("clash")).drop("_last")
    kept = {(r["ch"], r["chunk"]): r["kept"] for r in C.story_chunks(df, ["ch"], "chunk", "text").collect()}
    assert kept == {(1, 0): True, (1, 1): True, (1, 2): True, (1, 3): True, (1, 4): False, (1, 5): False, (None, 0): True, (2, 0): False, (2, 1): False}
    assert C.story_chunks(df.limit(0), ["ch"], "chunk", "text").count() == 0
    t = spark.createDataFrame([("A.\n…\nBye",), ("A.\n.\nBye",), ("A.\nTHANKS for  your suport",), ("A. ",), (None,)], "t string")
    assert [r[0] for r in t.select(C.without_trailing_notes(F.col("t"))).collect()] == ["A.\n"] * 4 + [None]
    p = spark.createDataFrame([("DoF 1.1 - Celebrity Escape [T3]",), ("7.12 - Compartmental",), ("News",), (None,)], "t string").select(C.post_title(F.col("t"), {"DoF": 7}).alias("p"))
    assert [r["p"] and tuple(r["p"]) for r in p.collect()] == [("DoF", 8, 1, "Celebrity Escape"), (None, 7, 12, "Compartmental"), None, None]


def test_takes(spark):
    shipped = spark.createDataFrame([(1, "a", 0.1, False), (1, "b", 0.5, True)], "t int, word string, distance double, faulty boolean")
    takes = spark.createDataFrame([(1, "a", 0.6, True), (1, "b", 0.53, True), (1, "c", 0.9, True), (1, "d", 0.9, False)], "t int, word string, distance double, faulty boolean")
    assert sorted(r["word"] for r in K.regressions(shipped, takes, ["t"]).collect()) == ["a", "c"]
    runs = spark.createDataFrame([(1, 1, 0.3, 0.5), (1, 2, 0.0, 0.5), (2, 1, 0.4, 0.5), (2, 2, 0.2, 0.5), (3, 1, 0.6, 0.5)], "t int, n int, s double, was double")
    assert {r["t"]: (r["attempt"], r["cleaned"]) for r in K.clean_pass(runs, ["t"], "n", "s", "was").collect()} == {1: (2, True), 2: (2, False), 3: (None, False)}


def test_outputs_and_renderings(spark):
    recorded = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "o string, i int, size int")
    present = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), ("d", 1, 1)], "o string, i int, size int")
    assert {r["o"]: r["stale"] for r in R.stale_outputs(recorded, present, ["o"], "i").collect()} == {"a": False, "b": True, "c": False, "d": True}
    blocks, pins = spark.createDataFrame([("k",), ("x",)], "block_key string"), spark.createDataFrame([("k", "said")], "key string, rendering string")
    assert {r[0]: r[1] for r in R.pinned(blocks, pins).collect()} == {"k": "said", "x": None}
    with pytest.raises(Exception, match="no rendering for x"):
        R.pinned(blocks, pins, strict=True).collect()
    marks = spark.createDataFrame([("The cat sat down by the gate", 0.1), ("Short", 0.0), ("x", None), (None, 0.5)], "t string, p double").select(R.marked_at(F.col("t"), F.col("p"))).collect()
    assert [r[0] for r in marks] == ["The ⟨▓⟩ cat sat down by the gate", "Short ⟨▓⟩", "x", None]
