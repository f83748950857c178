from __future__ import annotations

import hashlib
import os
import random
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storyloom.llm import sentences as S

# '|' stands where a unit ends; it isn't part of the text.
CASES = [
    "Dr. Vell paid £19.0m for it. |Prof. Ash left.",
    "See Vol. 7, Ch. 33 for how Ash vs. Reed ended, approx. 33.5 pages in. |Then he left.",
    "The keeper opened at 7 p.m. |Hob was late.",
    "It weighed 77.7 kg, i.e. more than the bridge.",
    "Elka asked for the bow etc. and got 74.7 gold instead. |She left.",
    "“Is that his dungeon?” |“No. |It belongs to Marrow.” |Nothing moved.",
    '"Stop!" Ansel screamed. |"Where is it?" Tamsett asked. |"I kept a mud!" said Hob.',
    "Ondine left. |iron-shod boots crossed the hall. |eBrix hummed.",
    "The hall was hollow... |Nobody answered. |Dov hesitated... then left.",
    "Wait. |Wait… Idris had it all along! |Corvo scored the 2nd. goal.",
    "Tavi lived in the U. R. S. |Okoro never did. |The F. A. of Reed fined him.",
    "[Level up! |Imre has reached Lv. 15.] |Zadie left.",
    "What?! |Fenn left (by boat).",
    "„Komm mit, Pell!“, rief Galt. |Er wohnt z. B. in Nr. 69, d. h. neben Dov. |Am 32. Mai kam er. |Im 8. Jahrhundert auch.",
    "« Où est la carte ? » demanda Fenn à Ash. |« Je pars. |Tu viens, Elka ? » |Voir p. ex. le chap. 72, au 8 av. J.-C. à Portsel.",
    "—¿Dónde está? —preguntó Galt. |—Me voy. |¿Vienes? —dijo. |El Sr. Odd pagó 63.500 pts. por él a las 16.30 h. con gusto.",
    "«Не трогай!» — крикнул Ждан. |— Где ключ? — спросил он. |«Мы проиграли. |Он ушёл», — сказал Ждан.",
    "“我们输给了他。|地图不在了。”江晚照低声说。|什么？！|他走了。|“在哪里？”沈归舟问道。|重77.3公斤。",
    "「なぜだ！？」と彼は叫んだ。|「行こう」彼は書を取った。|「待て。|返せ」と言った。|Lv.89の彼が現れた！",
    "سأل تيماء: «أين الصندوق؟» |«توقف. |أعد السيف»، قال ربابة. |دفع د. ربابة 27.5 دينار. |تردد... ثم أخذ المفتاح.",
    "“दीपक कहाँ है?” मेघना ने पूछा। |“रुको। |वापस दो,” उसने कहा। |डॉ. राम ने 68.5 रुपये दिए।",
    "no end mark\n|second line\r\n|third",
    "1. First item of a list",
]


@pytest.mark.parametrize("case", CASES)
def test_units(case):
    text = case.replace("|", "")
    wanted = [p.strip() for p in case.split("|")]
    assert [text[a:b] for a, b in S.units(text)] == wanted


def test_every_visible_character_lies_in_one_unit():
    r = random.Random(2)
    alphabet = "aB. !?\"“”«»(…。！？」 \n\r\t\xa0​—1ก ขЖ汉,"
    model = S.train(["กขค งจฉ\nกขค\nงจฉ", "汉Ж汉。Ж汉汉。\n汉汉汉汉。" * 3])
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(50)))
        covered = [0] * len(text)
        for a, b in S.units(text, model):
            assert a < b and not text[a].isspace() and not text[b - 1].isspace() and not re.search("[\n\r]", text[a:b])
            for i in range(a, b):
                covered[i] += 1
        assert all(n == 1 for n, c in zip(covered, text) if not c.isspace()) and max(covered, default=0) <= 1


def test_unmarked_script_is_learnt_from_its_breaks():
    names, places = ["ดารินกาทอง", "สิงขรหมอกขาว", "ธาราเถ้าดำ"], ["เมืองเกลือ", "ตลาดเถ้า"]
    r = random.Random(4)
    forms = [lambda: f"{r.choice(names)}จ่าย {r.randrange(90)}.50 บาทเพื่อซื้อดาบเก่า", lambda: f"{r.choice(names)}พูดว่า “อย่าแตะดาบ” แล้ววิ่งหนี", lambda: f"คืนนั้น{r.choice(names)}ขายหีบให้พ่อค้าที่{r.choice(places)}", lambda: f"{r.choice(names)}ถามว่าหีบเงินอยู่ที่ไหน"]
    line = lambda n: [r.choice(forms)() for _ in range(n)]
    model = S.train(["\n".join(" ".join(line(r.randrange(1, 5))) for _ in range(400))])
    right = total = 0
    for _ in range(100):
        wanted = line(4)
        text = " ".join(wanted)
        got = {b for _, b in S.units(text, model)}
        ends, at = set(), -1
        for w in wanted:
            at += len(w) + 1
            ends.add(at)
        right += len(got & ends)
        total += len(got | ends)
    assert right / total > 0.95


def test_viterbi_finds_the_best_tagging():
    r = random.Random(6)
    for _ in range(200):
        n = r.randrange(1, 8)
        scores, filled, rooms = [r.uniform(-5, 5) for _ in range(n)], [r.random() < 0.7 for _ in range(n)], [r.choice(["4", "more"]) for _ in range(n)]
        weights = {"BB empty": -12.0, **{f"{x}B{y}": r.uniform(-3, 3) for x in "BI" for y in ("4", "more")}}

        def value(tags):
            total, last = 0.0, True
            for s, f, room, t in zip(scores, filled, rooms, tags):
                total += (s + weights[("B" if last else "I") + "B" + room] - (12 if last and not f else 0)) if t else 0
                last = t
            return total

        best = max(value([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert value(S.viterbi(scores, filled, weights, rooms)) == pytest.approx(best)


def test_abbreviations_and_tags_are_learnt_from_wide_gaps():
    r = random.Random(8)
    names = ["Meyer", "Vell", "Ash", "Hob", "Galt"]
    unit = lambda: r.choice(["Kapt. {} kam.", "See Op. {} for it.", "{} left.", "{} slept."]).format(r.choice(names))
    text = "Kapt. Ash rief. Galt und Op. Vell blieben."
    plain = [text[a:b] for a, b in S.units(text)]
    model = S.train(["  ".join(unit() for _ in range(12)) for _ in range(60)])
    assert plain == ["Kapt.", "Ash rief.", "Galt und Op.", "Vell blieben."]
    assert [text[a:b] for a, b in S.units(text, model)] == ["Kapt. Ash rief.", "Galt und Op. Vell blieben."]


def test_lines_of_han_without_marks_are_learnt_from_stripped_marks():
    r = random.Random(9)
    who, what, where = ["江晚照", "沈归舟", "陆青禾"], ["玉简", "灯笼", "旧剑"], ["青云镇", "盐门"]
    unit = lambda: r.choice([lambda: f"{r.choice(who)}在{r.choice(where)}捡到了{r.choice(what)}", lambda: f"自从围城之后{r.choice(where)}再也没有人见过{r.choice(what)}", lambda: f"{r.choice(who)}沉默了很久"])()
    model = S.train(["。".join(unit() for _ in range(20)) + "。" for _ in range(60)])
    right = told = wanted = 0
    for _ in range(60):
        parts = [unit() for _ in range(4)]
        text, ends, at = "".join(parts), set(), 0
        for p in parts:
            at += len(p)
            ends.add(at)
        got = {b for _, b in S.units(text, model)}
        right, told, wanted = right + len(got & ends), told + len(got), wanted + len(ends)
    assert right / wanted > 0.9 and right / told > 0.9
    assert S.units("自从围城之后盐门再也没有人见过玉简") == [(0, 17)]


def test_long_lines_take_time_in_proportion():
    def seconds(n):
        text = "Mr. Ash said “No! Yes?” etc. 3.5 a.b " * n + "! " * n
        start = time.perf_counter()
        S.units(text)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(8000) < 16 * seconds(1000) + 1


def test_held_out_texts_by_language(data):
    """Lines whose ends are shown by two spaces, of texts the model wasn't trained on; see README."""
    rows = pq.read_table(f"{os.path.dirname(data)}/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    texts = sorted({(r["text"], (r["lang"] or "")[:2].lower()) for r in rows if r["text"]})
    fold = lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[0] % 2
    tagger = S.Tagger(S.train([t for t, _ in texts if fold(t)]))
    counts: dict = {}
    for t, lang in texts:
        if not fold(t) and S._wide_gaps(t):
            for _, _, _, chain in tagger.lines(t, labels=True):
                if any(chain.known):
                    c = counts.setdefault(lang, Counter())
                    c.update((tag, known) for tag, known in zip(tagger.tags(chain), chain.known))
    assert counts
    for c in counts.values():
        hit = c[True, True]
        assert hit >= 0.9 * (hit + c[False, True]) and hit >= 0.9 * (hit + c[True, False])


def test_rows(spark):
    texts = spark.createDataFrame([("d", 1, "One. Two."), ("d", 2, None), ("d", 3, " \n "), ("j", None, "Three"), ("d", 1, "One. Two.")], "place string, row_id long, text string").withColumn("char_start", F.lit("clash"))
    got = sorted(map(tuple, S.sentence_units(texts, {}).collect()), key=repr)
    assert got == sorted([("d", 1, 0, 4), ("d", 1, 5, 9), ("d", 1, 0, 4), ("d", 1, 5, 9), ("j", None, 0, 5)], key=repr)
    assert S.sentence_units(texts.limit(0), {}).count() == 0
    assert S.sentence_model_of(texts) == S.INITIAL == S.sentence_model_of(texts.limit(0))
