"""Encoding against the public libraries, and container filling against brute force."""

from __future__ import annotations

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import packing as P
from storyloom.llm import tokenizer as T

PATH = os.path.join(T.TOKENIZER_DIR, "byte_bpe_50k.json")
if not os.path.exists(PATH):
    pytest.skip("no vocabulary files", allow_module_level=True)
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def encoded(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    out = []
    for _, values, counts, _ in T.encode_batches(iter([batch]), PATH, "k", "t"):
        ends = np.cumsum(counts)
        out += [values[a:b].tolist() for a, b in zip(ends - counts, ends)]
    return out


def test_any_text_is_encoded_as_by_the_library(reference):
    r = random.Random(3)
    alphabet = "ab'sStdrelvmL 　\xa0 \n\t\r.,!12²½éЖ汉กั🎉\x85\x1c​<|endoftext|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a" * 5001, " " * 77, "'''s 'serve don't we'll", "aaaa" * 30 + "bbb", "汉字" * 999, "\n \n  x"]
    assert encoded(texts) == reference(texts)


def test_blocks_and_flushes_change_nothing(reference, monkeypatch):
    texts = [f"Text number {i}, told twice.\n" * (i % 5) for i in range(200)]
    monkeypatch.setattr(T, "BLOCK_CHARS", 50)
    monkeypatch.setattr(T, "FLUSH_CHARS", 300)
    monkeypatch.setattr(T, "CACHE_WORDS", 5)
    assert encoded(texts) == reference(texts)


def test_words_of_one_hash_are_still_told_apart(reference, monkeypatch):
    T._shared(PATH)
    monkeypatch.setitem(T._worker, "mix", np.zeros(0x110000, np.uint64))
    texts = ["cat dog bird", "bird cat"]
    assert encoded(texts) == reference(texts)


def test_corpus_rows(spark, reference):
    df = spark.createDataFrame([(1, "Hello there"), (2, None), (3, ""), (None, "x"), (1, "Hello there")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = T.encode_corpus(df)
    assert got.columns == ["doc_id", "ids"]
    hello, x = reference(["Hello there", "x"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, [got.collect()[0].__class__(doc_id=k, ids=i) for k, i in [(1, hello), (2, []), (3, []), (None, x), (1, hello)]]))
    assert T.encode_corpus(df.limit(0)).count() == 0


def test_fullest_combination_is_the_best_there_is():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.randrange(1, 40)
        items = [r.randrange(1, 30) for _ in range(r.randrange(8))]
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= capacity)
        taken = P.fullest(capacity, np.bincount(items, minlength=max(capacity + 1, 31)))
        assert sum(k * n for k, n in taken) == best
        assert all(n <= Counter(items)[k] for k, n in taken)


def test_bins_hold_everything_once_and_waste_little():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        sizes = np.minimum(2048, np.maximum(1, r.lognormal(6, 1, n).astype(int)))
        bins = P.minimum_slack_bins(sizes, 2048)
        loads = np.bincount(bins, weights=sizes) if n else np.zeros(0)
        assert len(bins) == n and (loads <= 2048).all() and (loads > 0).all()
        assert len(loads) <= sizes.sum() / 2048 + 1 + (n < 100) * n


def test_packed_rows(spark, reference):
    texts = [(1, "word " * 3000), (2, None), (3, ""), (4, "short"), (5, "short"), (5, "short"), (6, "a b c d e " * 150)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("piece", F.lit("clash")).coalesce(1)
    rows = P.pack_texts(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["token_start"], r["token_end"], r["n_tokens"]))
    n = len(reference(["word " * 3000])[0])
    assert sorted(by[1]) == [(0, 0, 2048, 2048), (1, 2048, n, n - 2048)]
    assert by[2] == by[3] == [(0, 0, 0, 0)] and len(by[5]) == 2
    loads = Counter()
    for r in rows:
        loads[r["container_id"]] += r["n_tokens"]
    assert max(loads.values()) <= 2048 and len(loads) == 2
    assert P.pack_texts(df.limit(0)).count() == 0
    assert {r["container_id"] for r in P.pack_texts(df.where("text is null")).collect()} == {0}
