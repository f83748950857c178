"""How often every distinct term or run of terms occurs, and in how many records (problem 4).

Suffix-sorted counting: each record's term sequence gives its suffixes, truncated to the longest wanted length and
routed by their first term; sorted in descending order, the counts of all their prefixes are gathered by one stack.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separates terms in a suffix; sorts below every character of a term, so prefixes stand next to their extensions.
SEP = "\x01"


def terms_of(text: Column) -> Column:
    """The longest runs of letters, marks and digits, lower-cased, in order. Null gives null, no run an empty list."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def whole_value(text: Column) -> Column:
    """The value without outer white space, lower-cased, as the only term; none if that is empty. Null gives null."""
    bare = F.lower(F.regexp_replace(text, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(bare == "", F.array().cast("array<string>")).when(bare.isNotNull(), F.array(bare))


def _shared_terms(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _suffixes(sequences: list[list[str]], longest: int) -> Iterator[tuple[str, int]]:
    """(suffix, seen) of one record: its first ``seen`` terms also begin a suffix that came before in this record.

    So a prefix of more than ``seen`` terms is new in the record, and counting those counts records.
    """
    all_ = sorted(s[i : i + longest] for s in sequences for i in range(len(s)))
    before: list[str] = []
    for s in all_:
        yield SEP.join(s), _shared_terms(before, s)
        before = s


def _stack_counts(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(terms, occurrences, records) of every prefix of suffixes that come in descending order with (seen, count)."""
    terms: list[str] = []
    occurrences: list[int] = []
    records: list[int] = []

    def pop_to(depth: int) -> Iterator[tuple[str, int, int]]:
        while len(terms) > depth:
            n, r = occurrences.pop(), records.pop()
            yield SEP.join(terms), n, r
            terms.pop()
            if terms:
                occurrences[-1] += n

    for suffix, seen, count in rows:
        s = suffix.split(SEP)
        yield from pop_to(_shared_terms(terms, s))
        while len(terms) < len(s):
            terms.append(s[len(terms)])
            occurrences.append(0)
            records.append(0)
        occurrences[-1] += count
        for depth in range(seen, len(s)):
            records[depth] += count
    yield from pop_to(0)


def ngram_counts(sequences: DataFrame, group: str, record: str, terms: str, longest: int = 3) -> DataFrame:
    """Occurrences and records of every run of up to ``longest`` terms: ``group``, ngram (terms joined by spaces),
    n_terms, occurrences, records.

    ``sequences`` has the columns ``group`` (string), ``record`` and ``terms`` (array of strings). Rows with the same group
    and record are one record; exactly repeated ones count once, different ones together. Null records, null and empty
    sequences count nothing; null or empty terms are left out; a null group counts as ''. Other columns are ignored. An empty table gives an empty result.

    Equal suffixes are counted within each partition before they are routed by their first term. Those of one first term
    are spread by their second over as many ways as the session has shuffle partitions, so a frequent term never
    meets in one task; a last sum joins the parts. Nothing depends on how many terms or rows there are.
    """
    base = sequences.where(F.col(record).isNotNull() & (F.size(terms) > 0)).select(F.col(group).alias("_g"), F.col(record).alias("_r"), F.filter(terms, lambda t: F.coalesce(t, F.lit("")) != "").alias("_t"))
    own = base.groupBy("_g", "_r").agg(F.collect_set("_t").alias("_s"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(counts)
            cols = [pa.array(x, t) for x, t in zip(zip(*keys), (pa.string(), pa.string(), pa.int32()))]
            batch = pa.RecordBatch.from_arrays([*cols, pa.array(list(counts.values()), pa.int64())], names=["_g", "_s", "_seen", "_n"])
            counts.clear()
            return batch

        for batch in batches:
            for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for suffix, seen in _suffixes(s, longest):
                    counts[g, suffix, seen] += 1
            if len(counts) > 200_000:
                yield out()
        if counts:
            yield out()

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            g, t, n, r = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(r, pa.int64())], names=["_g", "_t", "_o", "_rec"])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

        # The group goes in front of the suffix as a term of its own, so one stack serves all groups.
        mark = (((g or "") + SEP + s, seen + 1, n) for g, s, seen, n in rows())
        held: list[tuple] = []
        for key, o, r in _stack_counts(mark):
            g, _, t = key.partition(SEP)
            if t:
                held.append((g, t, o, r))
            if len(held) >= 50_000:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    pieces = own.select("_g", "_s").mapInArrow(emit, "_g string, _s string, _seen int, _n long")
    parts = F.split("_s", SEP)
    ways = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = pieces.repartition(F.col("_g"), parts[0], F.pmod(F.xxhash64(F.get(parts, F.lit(1))), F.lit(ways)))
    counted = routed.sortWithinPartitions(F.desc("_g"), F.desc("_s")).mapInArrow(stack, "_g string, _t string, _o long, _rec long")
    total = counted.groupBy("_g", "_t").agg(F.sum("_o").alias("occurrences"), F.sum("_rec").alias("records"))
    return total.select(F.col("_g").alias(group), F.translate("_t", SEP, " ").alias("ngram"), F.size(F.split("_t", SEP)).alias("n_terms"), "occurrences", "records")


def marked(counts: DataFrame, records: DataFrame, record: str, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """``counts`` with a verdict: rare in fewer than ``rare_below`` records, common in more than the share
    ``common_above`` of all distinct non-null ``record`` values of ``records``, else null; rare comes first."""
    total = records.select(F.count_distinct(record)).scalar()
    return counts.withColumn("verdict", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common"))
