"""One form for texts that look the same (problem 3).

Look-alikes — code points, and strings of them — are joined into transitive classes by union-find; each class is
rewritten to one representative by a multi-pattern automaton that takes the longest match at each place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Spellings of one form that are paired in one group.
BLOCK_TEXTS = 1000
#: Letters of other scripts drawn like a Latin letter, as "letter: look-alikes".
LOOK_ALIKES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "Ꮐ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫ", "K": "ΚКᏦ", "L": "Ꮮ",
    "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "V": "ᏙѴ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮУ", "Z": "ΖᏃ",
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "ј", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү", "-": "‐‑", ".": "․", "·": "‧", ";": ";",
}
#: Kinds of compatibility decomposition whose two sides look the same; raised, lowered, circled ones and fractions don't.
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Compatibility characters that are drawn unlike what they decompose to.
_UNLIKE = {"ſ", "ẛ"}
#: Characters that can't be seen though they aren't of category Cf or Cc.
_UNSEEN = (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))


class Classes:
    """Union-find over strings (code points are strings of length 1)."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[b] = a

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


def _links(seen: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same, for the code points that occur."""
    unseen = {chr(c) for c in _UNSEEN}
    for letter, others in LOOK_ALIKES.items():
        for x in others:
            yield letter, x
    yield "\n", "\r\n"
    yield "\n", "\r"
    yield "\n", " "
    yield "\n", " "
    yield " ", "\t"
    for ch in seen:
        kind = unicodedata.category(ch)
        if ch in unseen or kind in ("Cf", "Cc") and ch not in "\t\n\r\x0b\x0c\x85":
            yield "", ch
        elif kind == "Zs":
            yield " ", ch
        elif ch in "\x0b\x0c\x85":
            yield "\n", ch
        else:
            tag, _, rest = unicodedata.decomposition(ch).rpartition("> ")
            if tag and tag + ">" in _SAME_LOOK and ch not in _UNLIKE:
                yield unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split())), ch


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """Pattern → representative, for texts in canonical decomposition, from the code points' frequencies.

    A class's representative is its most frequent code point (of ties, the lowest), or nothing if it holds the empty
    string. A class with a longer string keeps that string, as its parts recur in other classes.
    """
    classes = Classes()
    for a, b in _links(counts):
        classes.join(a, b)
    whole: dict[str, str] = {}
    single: dict[str, str] = {}
    for members in classes.members().values():
        if "" in members:
            single.update((m, "") for m in members if m)
            continue
        longer = [m for m in members if len(m) > 1 and m != "\r\n"]
        if longer:
            whole.update((m, min(longer, key=lambda m: (len(m), m))) for m in members)
        else:
            best = min((m for m in members if len(m) == 1), key=lambda m: (-counts.get(m, 0), m))
            single.update((m, best) for m in members)
    # The parts of a longer representative are themselves rewritten, until nothing changes.
    def parts(s: str, depth: int = 0) -> str:
        if s in single:
            return single[s]
        if depth < 8 and len(s) == 1 and s in whole:
            return "".join(parts(c, depth + 1) for c in whole[s])
        return s

    rules = dict(single)
    rules.update((m, "".join(parts(c) for c in w)) for m, w in whole.items() if len(m) == 1)
    return {m: r for m, r in rules.items() if m != r}


def automaton(rules: dict[str, str]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for pattern, to in rules.items():
        auto.add_word(pattern, (len(pattern), to))
    if rules:
        auto.make_automaton()
    return auto


def rewrite(text: str | None, auto: ahocorasick.Automaton) -> str | None:
    """The text's one form: decomposed, rewritten left to right by the longest patterns, and composed again."""
    if not text:
        return text
    if text.isascii() and text.isprintable() and (not len(auto) or next(auto.iter(text), None) is None):
        return text  # an ASCII character is a pattern where its look-alike is more frequent
    text = unicodedata.normalize("NFD", text)
    out, at = [], 0
    if len(auto):
        for end, (size, to) in auto.iter_long(text):
            out.append(text[at : end + 1 - size])
            out.append(to)
            at = end + 1
    out.append(text[at:])
    return unicodedata.normalize("NFC", "".join(out))


def code_point_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How often each code point of the decomposed texts occurs in ``columns``; at most as many as Unicode has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for col in batch.columns:
                text = unicodedata.normalize("NFD", "".join(x for x in col.to_pylist() if x))
                found, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
                total[found] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["cp", "n"])

    per = df.select(*columns).mapInArrow(count, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n"))
    return {chr(r["cp"]): r["n"] for r in per.collect()}


def with_one_form(df: DataFrame, columns: list[str], counts: dict[str, int] | None = None) -> DataFrame:
    """``df`` with a column ``<name>_form`` for each of ``columns``: texts that look the same have equal forms.

    Width, composition and script of characters, kinds of white space and invisible characters make no difference;
    letter case, accents, raised digits and other letters do. Null stays null, an empty text empty. All rows and other columns
    stay; an existing column of a new name is replaced. An empty table gives an empty result.
    One job counts code points, unless their ``counts`` are given; their number, and so what the driver holds and sends out,
    is bounded by Unicode.
    """
    rules = rewriting(code_point_counts(df, columns) if counts is None else counts)

    @F.pandas_udf("string")
    def form(texts):  # noqa: ANN001, ANN202
        auto = automaton(rules)
        return texts.map(lambda t: rewrite(t, auto), na_action="ignore")

    return df.withColumns({f"{c}_form": form(F.col(c)) for c in columns})


def look_alike_classes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(field_name, key, text, form, class_id, links), distinct: every key with a text in ``columns`` whose look another,
    different text of the same column shares. ``links`` is the number of (key, text) with such other texts.

    A class is named by a 64-bit hash of its field and form, which also is there itself. Copies of a text have no links to each other. Null keys
    and texts are in no class; repeated rows count once. Other columns of ``df`` are left out. An empty table gives an empty result.

    Forms are made once and written; classes and links come from counts by text and by form, without pairs.
    """
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in columns)))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), fields.alias("_f")).select("key", "_f.*").where("text is not null").distinct()
    forms = written(with_one_form(rows, ["text"], code_point_counts(df, columns)).withColumnRenamed("text_form", "form"))
    per_text = forms.groupBy("field_name", "form", "text").agg(F.count("*").alias("_same"))
    per_form = per_text.groupBy("field_name", "form").agg(F.count("*").alias("_texts"), F.sum("_same").alias("_all")).where("_texts > 1")
    known = per_text.join(per_form, ["field_name", "form"])
    return forms.join(known, ["field_name", "form", "text"]).select("field_name", "key", "text", "form", F.xxhash64("field_name", "form").alias("class_id"), (F.col("_all") - F.col("_same")).alias("links"))


def pairs_of(classes: DataFrame) -> DataFrame:
    """(field_name, case_a, case_b): different keys, the lower first, of one class whose texts aren't equal.

    Texts are paired once for each form and pair of different spellings, however many keys share a spelling, and keys
    are attached afterwards; so copies never meet each other. A form of many spellings is met in blocks of BLOCK_TEXTS: each
    block is a group of its own in the join. A key with several texts is paired by each of them, but never with itself.
    """
    keys = written(classes.select("field_name", "form", "text", "key"))
    texts = keys.select("field_name", "form", "text").distinct()
    blocks = texts.groupBy("field_name", "form").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("_blocks"))
    sized = texts.join(blocks, ["field_name", "form"])
    left = sized.withColumn("_block", F.pmod(F.xxhash64("text"), F.col("_blocks")).cast("int"))
    right = sized.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumnRenamed("text", "_other")
    both = left.drop("_blocks").join(right.drop("_blocks"), ["field_name", "form", "_block"]).where("text < _other").select("field_name", "text", "_other")
    a, b = keys.select("field_name", "text", F.col("key").alias("_a")), keys.select("field_name", F.col("text").alias("_other"), F.col("key").alias("_b"))
    pairs = both.join(a, ["field_name", "text"]).join(b, ["field_name", "_other"]).where("_a <> _b")
    return pairs.select("field_name", F.least("_a", "_b").alias("case_a"), F.greatest("_a", "_b").alias("case_b")).distinct()
