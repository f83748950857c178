"""Lines repeated across one source's texts (problem 2).

Lines are parsed into fixed-depth token trees: the number of tokens and the first of them lead to a node, below which
leaves hold templates with wildcard slots. Nodes that cover too few records of their source are pruned first; the trees that
partitions build of the rest are merged, template against template, and templates that cover many records remain.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Stand in a template where a run of digits, or a whole token, may be any.
SLOT, WILD = "\x00", "\x02"
#: Tokens that lead to a node, and the share of tokens in which a line must agree with a template to join it.
DEPTH, ALIKE = 2, 0.6
_DIGITS = re.compile(r"\d+")
_ASCII_DIGIT = re.compile("[0-9]")
_THREE_LETTERS = re.compile(r"(?:[^\W\d_][\W\d_]*){3}")
#: What a worker holds at a time; beyond that it starts afresh, which changes no result of repeated_lines. Parsed lines kept, and the longest of
#: them in characters: long lines seldom recur. Bytes of the texts parsed together. Tokens of the templates in a partition's trees. Rows handed over together.
_SEEN, _SHORT, _BYTES, _TOKENS, _ROWS = 10_000, 200, 1 << 20, 300_000, 10_000


class LineParser:
    """(key, node, normalized line) of a line: tokens are separated by any white space and compared without regard to letter
    case; runs of digits are slots. The key of 128 bits depends on all tokens, the node's of 64 on their number and the
    first ``depth`` of them."""

    def __init__(self, depth: int = DEPTH):
        self.depth = depth
        self.seen: dict[str, tuple[bytes, int, str] | None] = {}

    def parse(self, line: str) -> tuple[bytes, int, str] | None:
        """None for a line with fewer than three letters."""
        try:
            return self.seen[line]
        except KeyError:
            pass
        found = self._parse(line) if _THREE_LETTERS.search(line) else None
        if len(line) <= _SHORT:
            if len(self.seen) >= _SEEN:
                self.seen.clear()
            self.seen[line] = found
        return found

    def _parse(self, line: str) -> tuple[bytes, int, str]:
        folded = line.casefold()
        if not folded.isascii() or _ASCII_DIGIT.search(folded):
            folded = _DIGITS.sub(SLOT, folded)
        tokens = folded.split()
        whole = " ".join(tokens)
        node = xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[: self.depth])}") - (1 << 63)
        return xxhash.xxh3_128_digest(whole), node, whole


class Leaf:
    """The templates below one node; all have the same number of tokens."""

    def __init__(self) -> None:
        self.templates: list[list[str]] = []
        self.names: list[int] = []
        self.at: dict[tuple[int, str], list[int]] = {}

    def add(self, tokens: list[str], name: int, alike: float = ALIKE) -> int:
        """The name of the template that ``tokens`` — a line's or another tree's template — joins: the one that has most tokens,
        or wildcards, in common with them, if that is the share ``alike`` at least; else a new one, called ``name``."""
        hits: Counter = Counter()
        for i, t in enumerate(tokens):
            hits.update(self.at.get((i, t), ()))
        best = max(hits, key=lambda k: (hits[k], -k), default=None)
        if best is None or hits[best] < alike * len(tokens):
            self.templates.append(list(tokens))
            self.names.append(name)
            for i, t in enumerate(tokens):
                self.at.setdefault((i, t), []).append(len(self.templates) - 1)
            return name
        own = self.templates[best]
        for i, t in enumerate(tokens):
            if own[i] != t and own[i] != WILD:
                self.at[i, own[i]].remove(best)
                self.at.setdefault((i, WILD), []).append(best)
                own[i] = WILD
        return self.names[best]


def text_records(df: DataFrame, place: str, row_id: str, source: str, text: str, record: list[str] | None = None) -> DataFrame:
    """``df`` as (place, source, row_id, record, text) for the functions below; ``record`` are the columns that tell
    which rows are one record (default: the row id)."""
    parts = F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in record or []))
    which = F.unhex(F.md5(parts)) if record else F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")
    return df.select(F.lit(place).alias("place"), F.col(source).alias("source"), F.col(row_id).cast("long").alias("row_id"), which.alias("record"), F.col(text).alias("text"))


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``_BYTES`` of the texts in ``column``; a longer text is a slice by itself."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _parsed(records: DataFrame, depth: int) -> DataFrame:
    """(place, source, row_id, record, line_no, key, node, line) of each line that counts."""
    names = ["place", "source", "row_id", "record", "line_no", "key", "node", "line"]

    def lines_of(parser: LineParser, batch: pa.RecordBatch) -> pa.RecordBatch:
        parent: list[int] = []
        numbers: list[int] = []
        found: list[tuple[bytes, int, str]] = []
        for i, text in enumerate(batch.column(4).to_pylist()):
            for n, line in enumerate(text.split("\n"), 1):
                if len(line) > 2 and (x := parser.parse(line)) is not None:
                    parent.append(i)
                    numbers.append(n)
                    found.append(x)
        at = pa.array(parent, pa.int64())
        keys, nodes, lines = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(4)), pa.array(numbers, pa.int32()), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = LineParser(depth)
        gc.disable()  # many small objects and no cycles
        try:
            for batch in batches:
                for portion in _portions(batch, 4):
                    yield lines_of(parser, portion)
        finally:
            gc.enable()  # the worker goes on to other tasks
            pa.default_memory_pool().release_unused()

    return records.where("text is not null").mapInArrow(run, "place string, source string, row_id long, record binary, line_no int, key binary, node long, line string")


def _partition_trees(lines: DataFrame, alike: float) -> DataFrame:
    """(place, source, node, key, part, template): for each line of ``lines`` (place, source, node, key, line) the template ``part`` that it
    joined in its partition's tree (template null), and each such template itself (key null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves: dict[tuple, Leaf] = {}
        name = TaskContext.get().partitionId() << 40

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["place", "source", "node", "key", "part", "template"])

        def grown() -> Iterator[pa.RecordBatch]:
            rows = ((*at, None, n, " ".join(t)) for at, leaf in leaves.items() for t, n in zip(leaf.templates, leaf.names))
            while some := list(islice(rows, _ROWS)):
                yield packed(some)
            leaves.clear()

        held = 0
        for batch in batches:
            rows = []
            for place, source, node, key, line in zip(*(c.to_pylist() for c in batch.columns)):
                leaf = leaves.setdefault((place, source, node), Leaf())
                name += 1
                tokens = line.split(" ")
                part = leaf.add(tokens, name, alike)
                held += len(tokens) * (part == name)
                rows.append((place, source, node, key, part, None))
            if rows:
                yield packed(rows)
            if held >= _TOKENS:
                yield from grown()
                held = 0
        yield from grown()

    return lines.mapInArrow(run, "place string, source string, node long, key binary, part long, template string")


def _merged_trees(parts: DataFrame, alike: float) -> DataFrame:
    """(part, template_id, template): the partitions' templates (place, source, node, part, template), merged node by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, leaf = None, Leaf()
        joined: list[tuple[int, int]] = []

        def done() -> Iterator[pa.RecordBatch]:
            by = {n: " ".join(t) for t, n in zip(leaf.templates, leaf.names)}
            if joined:
                part, own = zip(*joined)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(own, pa.int64()), pa.array([by[n] for n in own], pa.string())], names=["part", "template_id", "template"])
            joined.clear()

        for batch in batches:
            for *at, part, template in zip(*(c.to_pylist() for c in batch.columns)):
                if at != node:
                    yield from done()
                    node, leaf = at, Leaf()
                joined.append((part, leaf.add(template.split(" "), part, alike)))
        yield from done()

    keys = ["place", "source", "node"]
    ordered = parts.select(*keys, "part", "template").repartition(*keys).sortWithinPartitions(*keys, "template", "part")
    return ordered.mapInArrow(run, "part long, template_id long, template string")


class Repeated:
    """Templates and lines that occur too often within a source; see ``repeated_lines`` for what counts."""

    def __init__(self, records: DataFrame, least_records: int = 4, least_share: float = 0.02, depth: int = DEPTH, alike: float = ALIKE):
        by = ["place", "source"]
        self.lines = written(_parsed(records, depth))
        own = self.lines.where("source is not null")
        per_source = written(records.where("source is not null").select(*by, "record").distinct().groupBy(*by).agg(F.count("*").alias("_of")))

        def often(counted: DataFrame) -> DataFrame:
            many = counted.where(F.col("_n") >= least_records).join(per_source, by)
            return many.where(F.col("_n") >= least_share * F.col("_of"))

        # A node covers at least what any template below it covers.
        # They are written first, so that their measured size decides whether lines are shuffled to meet them.
        nodes = written(often(own.select(*by, "node", "record").distinct().groupBy(*by, "node").agg(F.count("*").alias("_n"))).select(*by, "node"))
        self.below = below = written(own.join(nodes, [*by, "node"], "left_semi"))
        trees = written(_partition_trees(below.select(*by, "node", "key", "line").distinct(), alike))
        merged = _merged_trees(trees.where("template is not null"), alike)
        member = trees.where("key is not null").select(*by, "key", "part").join(merged, "part").drop("part")
        seen = below.select(*by, "key", "record").distinct()
        member = written(seen.join(member, [*by, "key"]))
        covered = often(member.select(*by, "template_id", "template", "record").distinct().groupBy(*by, "template_id", "template").agg(F.count("*").alias("_n")))
        self.templates = covered.select(*by, F.translate("template", SLOT + WILD, "#*").alias("template"), F.col("_n").alias("records"), (F.col("_n") / F.col("_of")).alias("share"))
        # Lines of the templates that remain are checked by themselves: their tokens must agree in all but digits.
        inside = member.join(covered.select(*by, "template_id"), [*by, "template_id"], "left_semi").groupBy(*by, "key").agg(F.count("*").alias("_n"))
        self.cases = written(often(inside).select(*by, "key"))

    def found(self) -> DataFrame:
        return self.below.join(self.cases, ["place", "source", "key"], "left_semi").select("place", "row_id", "line_no").distinct()

    def found_without_source(self) -> DataFrame:
        """(place, row_id, line_no) of the lines in rows without source that are a case of any source of their place."""
        cases = self.cases.select("place", "key").distinct()
        return self.lines.where("source is null").join(cases, ["place", "key"], "left_semi").select("place", "row_id", "line_no").distinct()


def repeated_lines(records: DataFrame, least_records: int = 4, least_share: float = 0.02) -> DataFrame:
    """(place, row_id, line_no), distinct: the lines to remove from ``records`` (see text_records).

    Lines end at line feeds and are numbered from 1. Two lines are the same if they differ at most in letter case, white
    space, or the digits of a run. A line is removed if it occurs in at least ``least_records`` records and at least the share
    ``least_share`` of all records of its source in its place; every record of the source counts, with a text or
    not. Rows without source, null texts and lines with fewer than three letters give nothing; repeated rows give their lines once.
    An empty table gives an empty result.

    A case's template, and its node, cover all records that the case occurs in, so neither pruning loses one. Records are counted by
    node, template or line and record before they are counted by the first alone, so a line that a third of all rows have doesn't meet in one
    task. Texts are parsed once, and what is read several times is written to the shared folder.
    """
    return Repeated(records, least_records, least_share).found()


def repeated_templates(records: DataFrame, least_records: int = 4, least_share: float = 0.02, alike: float = ALIKE) -> DataFrame:
    """(place, source, template, records, share) of the merged templates that cover enough records: '#' stands for any run of digits and
    '*' for any token. They also cover lines that differ in a name or a date and so aren't the same to ``repeated_lines``. Which
    of several templates a line joins depends on the order in which lines come."""
    return Repeated(records, least_records, least_share, alike=alike).templates


def without_lines(df: DataFrame, keys: list[str], text: str, found: DataFrame) -> DataFrame:
    """``df`` with ``text`` freed of the lines that ``found`` (``keys``, line_no) names; other rows and columns stay.

    A null text stays null, a text of which no line remains is empty.
    """
    lines = found.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.collect_set("line_no").alias("_lines"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_lines", (i + 1).cast("int")))
    same: Column = F.lit(True)
    for k in keys:
        same = same & (df[k] == lines[f"_{k}"])
    joined = df.join(lines, same, "left")
    return joined.withColumn(text, F.when(F.col("_lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_lines", *(f"_{k}" for k in keys))
