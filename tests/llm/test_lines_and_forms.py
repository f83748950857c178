from __future__ import annotations

import itertools
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from storyloom.llm import lookalike as L
from storyloom.llm import repeated_lines as R


def brute_lines(rows, least=4, share=0.02):
    of, seen = defaultdict(set), defaultdict(set)
    lines = []
    for row_id, source, record, text in rows:
        if source is None:
            continue
        of[source].add(record)
        for n, line in enumerate((text or "").split("\n"), 1):
            if sum(map(str.isalpha, line)) >= 3:
                key = source, " ".join(re.sub(r"\d+", "0", line.casefold()).split())
                seen[key].add(record)
                lines.append((row_id, n, key))
    return {(r, n) for r, n, key in lines if len(seen[key]) >= least and len(seen[key]) >= share * len(of[key[0]])}


def test_lines_against_brute_force(spark):
    r = random.Random(1)
    stock = ["Share this: Post | Mail", "SHARE\xa0this:  post | mail ", "Page 12 of 9", "page 7 of 100\r", "ab", "— 12 —", "Straße", "STRASSE", "a b c 1", "A B C 22", "١٢ pages here", "٣ pages here"]
    rows = []
    for i in range(600):
        source = r.choice(["a"] * 6 + ["b", "c", None])
        lines = [r.choice(stock) if r.random() < 0.2 else f"story {i} {k}" + "x" * i for k in range(r.randrange(1, 8))]
        rows.append((i, source, i // 2, r.choice(["\n".join(lines)] * 9 + [None])))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "id long, source string, rec long, text string").withColumn("line_no", F.lit("clash"))
    found = R.repeated_lines(R.text_records(df, "p", "id", "source", "text", ["rec"]))
    got = [(x["row_id"], x["line_no"]) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_lines(rows)
    clean = R.without_lines(df.select("id", "text", "source"), ["id"], "text", found.select(F.col("row_id").alias("id"), "line_no"))
    drop = brute_lines(rows)
    wanted = Counter((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in drop)) for i, _, _, t in rows)
    assert Counter((x["id"], x["text"]) for x in clean.collect()) == wanted


def test_no_lines(spark):
    df = spark.createDataFrame([], "id long, source string, text string")
    assert R.repeated_lines(R.text_records(df, "p", "id", "source", "text")).count() == 0


def test_keys_and_nodes_depend_on_tokens():
    a = R.LineParser(2)
    key, node, _ = a.parse("one two three 4")
    assert a.parse("One  TWO\xa0three 99")[:2] == (key, node) and a.parse("a1 2") is None
    assert a.parse("one two five 4")[1] == node and a.parse("one two five 4")[0] != key
    assert a.parse("one two three")[1] != node != a.parse("one x three 4")[1]


def test_a_parser_holds_little():
    parser = R.LineParser()
    tracemalloc.start()
    try:
        for i in range(30_000):
            parser.parse(f"line {i} of a story" + " and so on" * (30 * (i % 2)))
        assert tracemalloc.get_traced_memory()[0] < 8e6
    finally:
        tracemalloc.stop()


def test_portions_are_small_and_whole():
    texts = ["x" * n for n in (0, 5, R._BYTES, 3 * R._BYTES, 1, *[R._BYTES // 4] * 9, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1)), pa.array(["", *texts])], names=["id", "text"]).slice(1)
    parts = list(R._portions(batch, 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= R._BYTES for p in parts) and len(parts) < 8
    assert not list(R._portions(batch.slice(0, 0), 1))


def test_trees_are_handed_over_by_their_tokens(monkeypatch):
    monkeypatch.setattr(R, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = R._partition_trees(SimpleNamespace(mapInArrow=lambda f, _: f), R.ALIKE)
    taken, most, joined, named = 0, 0, [], []

    def batches():
        nonlocal taken
        for start in range(0, 20_000, 1_000):
            taken += 1_000
            rows = [("p", "s", i, b"%d" % i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(start, start + 1_000)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["place", "source", "node", "key", "line"])

    for batch in run(batches()):
        assert batch.num_rows <= 10_000
        for r in batch.to_pylist():
            (named if r["key"] is None else joined).append(r["part"])
        most = max(most, taken - len(named))
    assert sorted(joined) == sorted(named) and len(set(named)) == taken == 20_000
    assert most * 40 <= 400_000


def test_templates_merge_with_wildcards():
    leaf, other = R.Leaf(), R.Leaf()
    assert [leaf.add(x.split(), n) for n, x in enumerate(["posted by alice on monday", "posted by bob on friday", "posted by a guest reader", "posted by alice on sunday"])] == [0, 0, 2, 0]
    assert leaf.templates[0] == ["posted", "by", R.WILD, "on", R.WILD] and len(leaf.templates) == 2
    assert other.add("posted by carol on friday".split(), 7) == 7
    assert other.add(leaf.templates[0], 0) == 7 and other.templates == [leaf.templates[0]]


def test_bylines_that_differ_in_a_name_are_one_template(spark):
    names, days = ["Alice", "Bob", "Carol", "Dan", "Eve", "Finn"], ["Monday", "Friday", "Sunday"]
    rows = [(i, "a", f"Posted by {names[i % 6]} on {days[i % 3]}\nStory {'x' * i} goes {'y' * i}\nPage {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, source string, text string").repartition(4)
    got = {r["template"]: (r["records"], r["share"]) for r in R.repeated_templates(R.text_records(df, "p", "id", "source", "text")).collect()}
    assert got["posted by * on *"] == (60, 1.0) and got["page #"] == (60, 1.0)


SAME = ["Café gift ﬁne", "Café gift fine", "Ｃａｆé　gift fine", "Саfé\xa0gift f​ine", "C­afé gi﻿ft ﬁne", "Ⅽafé gift fine".replace("Ⅽ", "С")]
OTHER = ["Cafe gift fine", "café gift fine", "Café gift  fine"[:-1], "Café gift fne", "Café g1ft fine", "Café² gift fine", "Café2 gift fine", "Cafè gift fine"]


def test_forms():
    texts = SAME + OTHER
    rules = L.rewriting(Counter(c for t in texts for c in t))
    auto = L.automaton(rules)
    forms = [L.rewrite(t, auto) for t in texts]
    assert len(set(forms[: len(SAME)])) == 1 and len(set(forms)) == 1 + len(OTHER)
    assert [L.rewrite(f, auto) for f in forms] == forms
    assert L.rewrite("", auto) == "" and L.rewrite(None, auto) is None and L.rewrite("​", auto) == ""


def test_representative_is_the_most_frequent():
    rules = L.rewriting(Counter({"о": 9, "o": 1, "ﬁ": 1}))
    assert rules["o"] == "о" and "о" not in rules and rules["ﬁ"] == "fi"
    assert L.rewriting(Counter({"о": 1, "o": 9}))["о"] == "o"


def test_classes_are_transitive():
    c = L.Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "")):
        c.join(a, b)
    assert sorted(sorted(m) for m in c.members().values()) == [["", "x"], ["a", "b", "c", "d"]]


def test_pairs(spark):
    rows = [(i, t, None if i % 2 else t) for i, t in enumerate(SAME + OTHER)]
    rows += [(100, SAME[0], None), (101, SAME[0], ""), (None, SAME[1], ""), (102, None, "​")] + rows[:3]
    df = spark.createDataFrame(rows, "case_id long, input string, expected string").withColumn("field_name", F.lit("clash"))
    got = sorted(map(tuple, L.pairs_of(L.look_alike_classes(df, "case_id", ["input", "expected"])).collect()))
    same = [(i, t) for i, t, _ in dict.fromkeys(rows) if t in SAME and i is not None]
    wanted = {("input", min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(same, 2) if s != t}
    wanted |= {("expected", a, b) for a, b in itertools.combinations(range(0, len(SAME), 2), 2)} | {("expected", 101, 102)}
    assert got == sorted(wanted)
    assert L.pairs_of(L.look_alike_classes(df.limit(0), "case_id", ["input"])).count() == 0
    classes = L.look_alike_classes(df, "case_id", ["input"]).collect()
    assert {r["key"] for r in classes} == {i for i, _ in same} and len({r["class_id"] for r in classes}) == 1
    assert all(r["links"] == sum(t != r["text"] for _, t in same) for r in classes)


def test_many_spellings_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_TEXTS", 3)
    df = spark.createDataFrame([(i, "a" + "\u200b" * (i % 10)) for i in range(20)], "case_id long, input string")
    got = {(r["case_a"], r["case_b"]) for r in L.pairs_of(L.look_alike_classes(df, "case_id", ["input"])).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(20), 2) if a % 10 != b % 10}


def test_pairs_where_look_alikes_outnumber_ascii(spark):
    texts = ["оса", "oca", "oсa", "ｏca", "эхо", "эxo", "fine", "ﬁne", "dig", "оо аа сс хх ее іі", "оо аа сс хх ее іі"]
    df = spark.createDataFrame(list(enumerate(texts)), "case_id long, input string")
    got = {(r["case_a"], r["case_b"]) for r in L.pairs_of(L.look_alike_classes(df, "case_id", ["input"])).collect()}
    assert got == {*itertools.combinations(range(4), 2), (4, 5), (6, 7)}
    forms = {r["input"]: r["input_form"] for r in L.with_one_form(df, ["input"]).collect()}
    assert forms["oca"] == "оса" and forms["dig"] == "dіg"
