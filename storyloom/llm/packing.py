"""Filling containers of fixed capacity with texts measured in tokens (problem 7).

Each partition measures its texts and packs them by itself, so nothing is shuffled; what that costs is at most
the one container that a block of items leaves part-filled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tokenizer import TOKENIZER_DIR, encode_batches

#: Items packed together; a partition with more is packed in several blocks.
BLOCK_ITEMS = 1_000_000


def fullest(capacity: int, available: np.ndarray) -> list[tuple[int, int]]:
    """Lengths, with how often each is taken, of the fullest feasible combination with a sum up to ``capacity``.

    Subset sums by dynamic programming on a bitset: bit s is set when some combination has the sum s. Lengths come
    in descending order, each in groups of 1, 2, 4 ... of its copies, until the capacity itself is reached.
    """
    bits, mask, goal = 1, (1 << (capacity + 1)) - 1, 1 << capacity
    stages: list[tuple[int, int, int]] = []
    for length in (np.flatnonzero(available[1 : capacity + 1])[::-1] + 1).tolist():
        left, group = min(int(available[length]), capacity // length), 1
        while left:
            take = min(group, left)
            stages.append((bits, length, take))
            bits |= (bits << (length * take)) & mask
            left -= take
            group *= 2
        if bits & goal:
            break
    at = bits.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, take in reversed(stages):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return list(chosen.items())


def minimum_slack_bins(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin, from 0, of each item; sizes are 1 to ``capacity``.

    Minimum bin slack: a bin is seeded with the longest item left and completed by the fullest combination of the
    lengths still available, which is then removed. As only lengths matter, a combination is used as often as its
    lengths last.
    """
    bins = np.empty(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    available = np.bincount(sizes, minlength=capacity + 1)
    first = (np.cumsum(available) - available).tolist()
    made = 0
    longest = capacity
    while True:
        while longest and not available[longest]:
            longest -= 1
        if not longest:
            return bins
        available[longest] -= 1
        need = dict(fullest(capacity - longest, available))
        available[longest] += 1
        need[longest] = need.get(longest, 0) + 1
        times = min(int(available[x]) // k for x, k in need.items())
        for x, k in need.items():
            where = order[first[x] : first[x] + k * times]
            bins[where] = made + np.arange(k * times) // k
            first[x] += k * times
            available[x] -= k * times
        made += times


def pack_texts(df: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row for each piece of each row of ``df``: ``key``, piece, token_start, token_end, n_tokens, container_id.

    A text of more than ``capacity`` tokens is divided into pieces of ``capacity`` and a rest; no other text is
    divided. Null and empty texts have no tokens: their single row, of 0 tokens, stands in the first container of
    their block. Repeated rows are separate items; ties in length are taken in input order. Other columns are left
    out, so their names can't clash. An empty table gives an empty result.
    """
    path = os.path.join(folder, tokenizer)
    added = "piece int, token_start int, token_end int, n_tokens int, container_id long"
    schema = StructType(df.select(F.col(key)).schema.fields + StructType.fromDDL(added).fields)

    def packed(keys: pa.Array, tokens: np.ndarray, base: int) -> tuple[pa.RecordBatch, int]:
        pieces = np.maximum(1, -(-tokens // capacity))
        row = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        end = np.minimum(tokens[row], start + capacity)
        n = end - start
        full = n > 0
        bins = np.zeros(len(row), np.int64)
        bins[full] = minimum_slack_bins(n[full], capacity)
        used = int(bins.max()) + 1 if len(bins) else 0
        arrays = [keys.take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (piece, start, end, n)), pa.array(bins + base)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names), used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        for k, _, counts, _ in encode_batches(batches, path, "_key", "_text"):
            keys.append(k)
            tokens.append(counts)
            if sum(map(len, keys)) >= BLOCK_ITEMS:
                batch, used = packed(pa.concat_arrays(keys), np.concatenate(tokens), base)
                yield batch
                base += used
                keys, tokens = [], []
        if keys:
            yield packed(pa.concat_arrays(keys), np.concatenate(tokens), base)[0]

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)
