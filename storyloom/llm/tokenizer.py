"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Nothing is shuffled: each partition is read once, cut into pre-tokens with array operations, and its distinct
pre-tokens are merged together through a pair occurrence index.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folder of the public vocabulary files; a parameter of every operator here.
TOKENIZER_DIR = "/opt/tokenizers"
#: Characters cut into pre-tokens at a time, and characters whose distinct pre-tokens are merged together.
BLOCK_CHARS, FLUSH_CHARS = 2_000_000, 24_000_000
#: Distinct pre-tokens kept by a Python worker between flushes.
CACHE_WORDS = 400_000

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
# The white space of Unicode (property White_Space).
_WHITE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# The endings that the vocabulary's pattern splits off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _class_table() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(_WHITE)] = _SPACE
    return table


def _starts(cp: np.ndarray, cls: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. ``doc_start`` marks the first character of each text; ``cp`` holds at least one."""
    n = len(cp)
    white = cls == _SPACE
    prev_cls = np.empty_like(cls)
    prev_cls[0], prev_cls[1:] = 255, cls[:-1]
    prev_cls[doc_start] = 255
    after_blank = np.zeros(n, bool)
    after_blank[1:] = cp[:-1] == 0x20
    after_blank &= ~doc_start
    ends = np.ones(n, bool)  # the last character of a text
    ends[:-1] = doc_start[1:]
    before_word = np.zeros(n, bool)  # white space directly before another character of the same text
    before_word[:-1] = white[:-1] & ~white[1:]
    before_word &= ~ends
    start = np.where(white, (prev_cls != _SPACE) | before_word, (prev_cls != cls) & ~after_blank)
    mark = np.flatnonzero((cp == 0x27) & start)  # an apostrophe that begins a pre-token may begin an ending
    if len(mark):
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        same = np.concatenate([doc_start, np.ones(3, bool)])
        open_ = np.ones(len(mark), bool)
        for ending in _ENDINGS:
            hit = open_.copy()
            for i, ch in enumerate(ending, 1):
                hit &= (padded[mark + i] == ord(ch)) & ~same[mark + i]
            at = mark[hit]
            open_ &= ~hit
            start[at + 1] = False
            after = at + 1 + len(ending)
            after = after[after < n]
            # White space keeps its own rules, which already start a pre-token there.
            start[after] = True
    return start


class PairIndexBpe:
    """Byte-level BPE by a pair occurrence index.

    Every adjacent pair of the given words is filed under its merge rank with all its positions. The ranks that
    occur are applied in ascending order; each application rewrites all positions of the pair at once in linked
    lists and files the pairs that arise under their own, always higher, ranks.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte_id = np.array([vocab[names[b]] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.merged = [vocab[a + b] for a, b in pairs]
        made = {m: r for r, m in enumerate(self.merged)}
        if len(made) != len(pairs) or any(made.get(x, -1) >= r for r, (a, b) in enumerate(zip(self.left, self.right)) for x in (a, b)):
            raise ValueError("the merges aren't in the order in which their parts arise")
        keys = (np.array(self.left, np.int64) << 20) | np.array(self.right, np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_rank[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word). Words aren't empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        n = int(size.sum())
        tok = np.empty(n + 1, np.int32)
        tok[:n] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        tok[n] = (1 << 20) - 1  # stands beyond either end of a word; in no pair
        nxt = np.minimum(np.arange(1, n + 2), n)
        prv = np.arange(-1, n)
        nxt[first + size - 1] = n
        prv[first] = n
        rank = self._ranks(tok[:n], tok[nxt[:n]])
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        bounds = np.searchsorted(rank[at], np.arange(len(self.merged) + 1)).tolist()
        later: defaultdict[int, list[int]] = defaultdict(list)
        for r, (a, b, m) in enumerate(zip(self.left, self.right, self.merged)):
            more = later.pop(r, None)
            if bounds[r] == bounds[r + 1] and more is None:
                continue
            p = at[bounds[r] : bounds[r + 1]]
            if more is not None:
                p = np.concatenate([p, np.array(more)])
            p = p[(tok[p] == a) & (tok[nxt[p]] == b)]
            if a == b and len(p) > 1:
                # In a run of the same token only every second position, from the left, is a pair of its own.
                p.sort()
                i = np.arange(len(p))
                begin = np.ones(len(p), bool)
                begin[1:] = nxt[p[:-1]] != p[1:]
                p = p[(i - np.maximum.accumulate(np.where(begin, i, 0))) % 2 == 0]
            if not len(p):
                continue
            gone = nxt[p]
            tok[p], tok[gone] = m, -1
            nxt[p] = nxt[gone]
            prv[nxt[p]] = p
            before = prv[p]
            new = np.concatenate([before[tok[before] != m], p])
            rk = self._ranks(tok[new], tok[nxt[new]])
            ok = rk >= 0
            for k, x in zip(rk[ok].tolist(), new[ok].tolist()):
                later[k].append(x)
        alive = tok[:n] >= 0
        return tok[:n][alive], np.add.reduceat(alive.astype(np.int64), first) if len(words) else size


_worker: dict = {}


def _shared(path: str) -> dict:
    """What a Python worker keeps between tasks: class table, model, and the ids of words already merged."""
    if _worker.get("path") != path:
        mix = np.arange(0x110000, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mix = (mix ^ (mix >> np.uint64(shift))) * np.uint64(by)
        _worker.update(path=path, cls=_class_table(), mix=mix, bpe=PairIndexBpe(path), power=np.empty(0, np.uint64))
        _forget()
    return _worker


def _forget() -> None:
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    _worker.update(index=index, ids=np.empty(0, np.int32), counts=np.empty(0, np.int64))


# An odd multiplier and its inverse modulo 2**64, for hashes of stretches of text.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(w: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(w["power"]) < n:
        for name, base in (("power", _BASE), ("inverse", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            w[name] = np.multiply.accumulate(x)
    return w["power"], w["inverse"]


def _words(w: dict, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts, how many each text has). ``text``: all texts joined; sizes in characters."""
    counts = np.zeros(len(sizes), np.int64)
    n = len(text)
    if not n:
        return np.empty(0, np.int32), counts
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc_start = np.zeros(n, bool)
    at = np.cumsum(sizes) - sizes
    doc_start[at[sizes > 0]] = True
    start = np.flatnonzero(_starts(cp, w["cls"][cp], doc_start))
    end = np.append(start[1:], n)
    power, inverse = _powers(w, n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(w["mix"][cp] * power[:n], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    _, one, back = np.unique(h, return_index=True, return_inverse=True)
    size = end - start
    if not _all_same(cp, start, size, one, back):  # two words share a hash: compare the words themselves
        number = [w["index"][text[a:b].encode("utf-8", "surrogatepass")] for a, b in zip(start.tolist(), end.tolist())]
        numbers = np.array(number, np.int32)
    else:
        known = w["index"]
        own = np.fromiter((known[text[a:b].encode("utf-8", "surrogatepass")] for a, b in zip(start[one].tolist(), end[one].tolist())), np.int32, len(one))
        numbers = own[back]
    edges = np.searchsorted(start, np.append(at, n))
    return numbers, np.diff(edges)


def _all_same(cp: np.ndarray, start: np.ndarray, size: np.ndarray, one: np.ndarray, back: np.ndarray) -> bool:
    """Whether each word equals the one that stands for its hash, character by character."""
    if (size != size[one][back]).any():
        return False
    # The word's characters lie one after another in cp, so only the other side has to be gathered.
    shift = start[one][back] - start
    return bool((cp[np.arange(len(cp)) + np.repeat(shift, size)] == cp).all())


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters; no text is divided."""
    a = total = 0
    for b, n in enumerate(sizes.tolist()):
        if total and total + n > BLOCK_CHARS:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, key: str, text: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, word numbers' ids one after another, ids of each text) — as (keys, values, counts, nulls).

    Batches are gathered until FLUSH_CHARS characters have been cut up; then the new distinct words of them all
    go through the pair index together.
    """
    w = _shared(path)
    kept: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        done = len(w["counts"])
        if len(w["index"]) > done:
            new = list(w["index"])[done:]
            ids, counts = w["bpe"].encode(new)
            w["ids"], w["counts"] = np.concatenate([w["ids"], ids]), np.concatenate([w["counts"], counts])
        first = np.cumsum(w["counts"]) - w["counts"]
        for keys, numbers, per_text, nulls in kept:
            each = w["counts"][numbers]
            ends = np.concatenate([[0], np.cumsum(each)])
            values = w["ids"][np.repeat(first[numbers] - ends[:-1], each) + np.arange(ends[-1])]
            edges = ends[np.concatenate([[0], np.cumsum(per_text)])]
            yield keys, values, np.diff(edges), nulls
        kept.clear()
        if len(w["index"]) > CACHE_WORDS:
            _forget()

    for batch in batches:
        col = batch.column(text)
        nulls = np.asarray(pc.is_null(col))
        sizes = np.asarray(pc.fill_null(pc.utf8_length(col), 0)).astype(np.int64)
        for a, b in _blocks(sizes):
            part = "".join(x for x in col.slice(a, b - a).to_pylist() if x)
            kept.append((batch.column(key).slice(a, b - a), *_words(w, part, sizes[a:b]), nulls[a:b]))
            held += len(part)
            if held >= FLUSH_CHARS:
                yield from flush()
                held = 0
    yield from flush()


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row for each row of ``df``: ``key`` and ``ids``, the text's ids without special tokens.

    Any string in a text is ordinary text. A null or empty text has an empty list; a null key stays null; repeated
    rows stay repeated. Other columns of ``df`` are left out, so their names can't clash. An empty table gives an
    empty result. A narrow dependency: no shuffle, and a lost executor's partitions are simply read again.
    """
    path = os.path.join(folder, tokenizer)
    schema = StructType(df.select(F.col(key)).schema.fields + StructType.fromDDL("ids array<int>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values, counts, _ in encode_batches(batches, path, "_key", "_text"):
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys, lists], names=[key, "ids"])

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)
